"""Chinese-restaurant seating of many dishes at once, and the spelling model that stands on it."""

from __future__ import annotations

import numpy as np

#: Strength of every restaurant.
STRENGTH = 1.0
#: Steps after which ``Seats.steps`` first puts its tables back in order.
MOVES = 4
#: Customers of a dish up to which a sweep moves them one at a time; of larger dishes in ``LOTS`` lots.
ONE_BY_ONE, LOTS = 32, 8
#: Bytes of context of the spelling model. There are at most 258**3 grams of three symbols.
CONTEXT = 2
#: Symbols of the spelling model: bytes, then the begin and the end of a word.
BEGIN, END, SYMBOLS = 256, 257, 258
BITS = 9


def discount_of(ones: float, twos: float) -> float:
    """The usual estimate from how many counts are one and two."""
    return min(0.95, max(0.05, ones / max(1.0, ones + 2.0 * twos)))


def first_tables(customers: np.ndarray, opens: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables for a first seating, before any Gibbs sweep.

    Customers come one after the other, from the 33rd on in lots at the rates at
    a lot's begin. Sweeps start from here; what they converge to is not changed.
    """
    tables = np.ones(len(customers))
    live, j = np.flatnonzero(customers > 1), 1
    while len(live):
        lot = 1 if j < 32 else j // 4
        rate = opens[live] / (opens[live] + j - discount * tables[live])
        many = np.minimum(lot, customers[live] - j)
        tables[live] += rng.random(len(live)) < rate if lot == 1 else np.minimum(rng.poisson(rate * many), many)
        j += lot
        live = live[customers[live] > j]
    return np.where(customers > 0, tables, 0).astype(np.int64)


class Seats:
    """Customers at the tables of many dishes.

    ``tables`` has the number of tables of each dish, ``sizes`` the customers of
    each table, dish after dish. A dish is one word (or symbol) in one
    restaurant; its customers share the probability ``base`` of the parent.
    """

    def __init__(self, tables: np.ndarray, sizes: np.ndarray):
        self.tables, self.sizes = tables.astype(np.int64), sizes.astype(np.int64)

    @classmethod
    def start(cls, customers: np.ndarray, room: np.ndarray, base: np.ndarray, discount: float, rng: np.random.Generator) -> Seats:
        """A first seating: sizes by the law of a Pitman-Yor process, the rest at a dish's first table."""
        dishes = np.bincount(room, minlength=1)
        tables = first_tables(customers, (STRENGTH + discount * dishes[room]) * base, discount, rng)
        begin = np.cumsum(tables) - tables
        k = np.arange(1, 1001)
        law = np.cumprod(np.concatenate(([discount], (k[:-1] - discount) / k[1:])))
        sizes = np.searchsorted(np.cumsum(law), rng.random(int(tables.sum()))) + 1
        some = tables > 0
        owner = np.repeat(np.arange(len(tables)), tables)
        heads = np.zeros(len(sizes), dtype=bool)
        heads[begin[some]] = True
        others = np.bincount(owner[~heads], weights=sizes[~heads], minlength=len(tables))
        crowded = others > customers - 1
        sizes[crowded[owner] & ~heads] = 1
        others[crowded] = np.maximum(tables[crowded] - 1, 0)
        sizes[begin[some]] = (customers - others)[some]
        return cls(tables, sizes)

    def customers(self) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self.tables)), self.tables), weights=self.sizes, minlength=len(self.tables)).astype(np.int64)

    def steps(self, times: np.ndarray, take: bool, put: bool, room: np.ndarray, in_room: np.ndarray, base: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """``times`` steps for each dish; a step takes a random customer away (``take``), seats one (``put``), or does both.

        ``in_room`` has the tables of each restaurant and is kept up to date. A
        customer opens a table with weight (strength + discount * tables of the
        restaurant) * base, and joins one with weight size - discount. All
        dishes take their step at once, from the tables before it.
        """
        customers, done = self.customers(), 0
        dishes = np.flatnonzero(times > 0)
        while len(dishes):
            span = int(min(times[dishes].max() - done, max(MOVES, done)))
            space = self.tables[dishes] + (span if put else 0)
            off = np.cumsum(space) - space
            flat = np.zeros(int(space.sum()), dtype=np.int64)
            old = self.tables[dishes]
            begin = (np.cumsum(self.tables) - self.tables)[dishes]
            inner = np.arange(int(old.sum())) - np.repeat(np.cumsum(old) - old, old)
            flat[np.repeat(off, old) + inner] = self.sizes[np.repeat(begin, old) + inner]
            used, t, c = old.copy(), old.copy(), customers[dishes]
            for k in range(span):
                on = np.flatnonzero(times[dishes] > done + k)
                cum = np.cumsum(flat)
                before = np.where(off[on] > 0, cum[off[on] - 1], 0) if len(cum) else np.zeros(len(on), dtype=np.int64)
                gone = np.full(len(on), -1)
                change = np.zeros(len(on), dtype=np.int64)
                if take:
                    gone = (rng.random(len(on)) * c[on]).astype(np.int64)
                    at = np.searchsorted(cum, before + gone, side="right")
                    flat[at] -= 1
                    c[on] -= 1
                    change -= flat[at] == 0
                    t[on] += change
                if put:
                    rooms = room[dishes[on]]
                    opens = (STRENGTH + discount * (in_room[rooms] + change)) * base[dishes[on]]
                    fresh = rng.random(len(on)) * (opens + c[on] - discount * t[on]) < opens
                    fresh |= c[on] == 0
                    left = np.flatnonzero(~fresh)
                    while len(left):  # a table by a random customer of it, kept with 1 - discount / size
                        who = (rng.random(len(left)) * c[on[left]]).astype(np.int64)
                        if take:
                            who += who >= gone[left]
                        at = np.searchsorted(cum, before[left] + who, side="right")
                        ok = rng.random(len(left)) * flat[at] >= discount
                        flat[at[ok]] += 1
                        left = left[~ok]
                    new = on[fresh]
                    flat[off[new] + used[new]] = 1
                    used[new] += 1
                    t[new] += 1
                    c[on] += 1
                    change[fresh] += 1
                moved = np.flatnonzero(change)
                if len(moved):
                    np.add.at(in_room, room[dishes[on[moved]]], change[moved])
            done += span
            # tables back in order, the empty ones gone
            kept = flat > 0
            owner = np.repeat(dishes, space)[kept]
            others = np.ones(len(self.tables), dtype=bool)
            others[dishes] = False
            rest = np.repeat(others, self.tables)
            all_owner = np.concatenate((np.repeat(np.arange(len(self.tables)), self.tables)[rest], owner))
            order = np.argsort(all_owner, kind="stable")
            self.sizes = np.concatenate((self.sizes[rest], flat[kept]))[order]
            self.tables = np.bincount(all_owner, minlength=len(self.tables))
            customers[dishes] = c
            dishes = dishes[times[dishes] > done]

    def sweep(self, room, in_room, base, discount, rng) -> None:
        """A Gibbs sweep: every dish makes as many moves as it has customers, each takes a random one away and seats it again.

        Dishes beyond ``ONE_BY_ONE`` customers move them in ``LOTS`` lots, at the rates at a lot's begin.
        """
        customers = self.customers()
        self.steps(np.where((customers > 1) & (customers <= MOVES), customers, 0), True, True, room, in_room, base, discount, rng)
        many = customers > MOVES
        if not many.any():
            return
        mine = np.repeat(many, self.tables)
        part, c, args = Seats(self.tables[many], self.sizes[mine]), customers[many], (room[many], in_room, base[many], discount, rng)
        part.steps(np.where(c <= ONE_BY_ONE, c, 0), True, True, *args)
        large = c > ONE_BY_ONE
        for _ in range(LOTS if large.any() else 0):
            # each customer leaves with the same chance, so those of a table are one draw
            part._leave(np.where(np.repeat(large, part.tables), rng.binomial(part.sizes, 1.0 / LOTS), 0), room[many], in_room)
            part._lot(c - part.customers(), False, *args)
        owner = np.concatenate((np.repeat(np.flatnonzero(~many), self.tables[~many]), np.repeat(np.flatnonzero(many), part.tables)))
        self.sizes = np.concatenate((self.sizes[~mine], part.sizes))[np.argsort(owner, kind="stable")]
        self.tables = np.bincount(owner, minlength=len(many))

    def become(self, wanted: np.ndarray, room, in_room, base, discount, rng) -> None:
        """Customers come and go until each dish has ``wanted``: their children opened and closed tables.

        They do so one at a time in small dishes, and in lots of an eighth of
        their dish in large ones, at the rates at a lot's begin.
        """
        for take in (True, False):
            while True:
                customers = self.customers()
                left = customers - wanted if take else wanted - customers
                if not (left > 0).any():
                    break
                lot = np.where(left > 0, np.minimum(left, np.maximum(customers // 8, 1)), 0)
                if lot.max() == 1:
                    # what is small takes a step at a time
                    self.steps(np.minimum(np.maximum(left, 0), 8), take, not take, room, in_room, base, discount, rng)
                else:
                    self._lot(lot, take, room, in_room, base, discount, rng)

    def _leave(self, gone: np.ndarray, room, in_room) -> None:
        """``gone`` customers of each table leave at once."""
        owner, self.sizes = np.repeat(np.arange(len(self.tables)), self.tables), self.sizes - gone
        kept = self.sizes > 0
        tables = np.bincount(owner[kept], minlength=len(self.tables))
        np.add.at(in_room, room, tables - self.tables)
        self.sizes, self.tables = self.sizes[kept], tables

    def _lot(self, lot: np.ndarray, take: bool, room, in_room, base, discount, rng) -> None:
        """``lot`` customers of each dish leave or come at once."""
        cum, end = np.cumsum(self.sizes), np.cumsum(self.tables)
        before = np.concatenate(([0], cum))[end - self.tables]
        customers = np.concatenate(([0], cum))[end] - before
        dish = np.repeat(np.arange(len(lot)), lot)
        fresh = np.zeros(len(dish), dtype=bool)
        if not take:
            opens = (STRENGTH + discount * in_room[room[dish]]) * base[dish]
            # those of the lot that came before are there already
            there = customers[dish] + np.arange(len(dish)) - np.repeat(np.cumsum(lot) - lot, lot)
            fresh = (rng.random(len(dish)) * (opens + there - discount * self.tables[dish]) < opens) | (customers[dish] == 0)
        at, left = np.zeros(len(dish), dtype=np.int64), np.flatnonzero(~fresh)
        who = np.zeros(len(dish), dtype=np.int64)
        while len(left):
            who[left] = before[dish[left]] + (rng.random(len(left)) * customers[dish[left]]).astype(np.int64)
            at[left] = np.searchsorted(cum, who[left], side="right")
            left = left[rng.random(len(left)) * self.sizes[at[left]] < discount] if not take else left[:0]
        if take:  # each customer leaves once
            who, one = np.unique(who, return_index=True)
            np.subtract.at(self.sizes, at[one], 1)
        else:
            np.add.at(self.sizes, at[~fresh], 1)
        owner = np.concatenate((np.repeat(np.arange(len(lot)), self.tables), dish[fresh]))
        sizes = np.concatenate((self.sizes, np.ones(int(fresh.sum()), dtype=np.int64)))
        kept = sizes > 0
        order = np.argsort(owner[kept], kind="stable")
        tables = np.bincount(owner[kept], minlength=len(lot))
        np.add.at(in_room, room, tables - self.tables)
        self.sizes, self.tables = sizes[kept][order], tables


def events(words, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """(gram of each symbol with its context, number of symbols of each word)."""
    import pyarrow as pa

    if not pa.types.is_large_string(words.type):
        words = words.cast(pa.large_string())
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + n + 1]
    raw = words.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    size = np.diff(offsets)
    # `context` begins, then the bytes, then one end for every word
    begin = np.concatenate(([0], np.cumsum(size + context + 1)))
    line = np.full(int(begin[-1]), BEGIN, dtype=np.int64)
    line[begin[1:] - 1] = END
    spots = np.repeat(begin[:-1] + context - (offsets[:-1] - offsets[0]), size) + np.arange(len(data))
    line[spots] = data
    gram = np.zeros(len(line), dtype=np.int64)
    for k in range(context, -1, -1):
        part = np.full(len(line), BEGIN, dtype=np.int64)
        part[k:] = line[: len(line) - k]
        gram = (gram << BITS) | part
    is_event = np.ones(len(line), dtype=bool)
    for k in range(context):
        is_event[begin[:-1] + k] = False
    return gram[is_event], size + 1


class Spelling:
    """Restaurants of byte contexts: the base distribution of words.

    ``gram`` and ``times`` are the customers of the longest contexts, with every
    distinct word spelled once. Each context shares the parent of the context
    one byte shorter, down to a uniform base; tables are the parent's customers.
    """

    def __init__(self, gram: np.ndarray, times: np.ndarray, context: int, rng: np.random.Generator):
        order = np.argsort(gram)
        self.context, self.rng, self.grams, self.parents = context, rng, [gram[order]], []
        for level in range(context):
            unique, up = np.unique(self.grams[level] & ((1 << (BITS * (context - level))) - 1), return_inverse=True)
            self.grams.append(unique)
            self.parents.append(up)
        self.room = [np.unique(g >> BITS, return_inverse=True)[1] for g in self.grams]
        self.seats: list[Seats] = []
        self.discount: list[float] = []
        customers = times[order].astype(np.int64)
        for level in range(context + 1):
            self.discount.append(discount_of((customers == 1).sum(), (customers == 2).sum()))
            base = np.full(len(customers), 1.0 / SYMBOLS)  # the parent is not known yet
            self.seats.append(Seats.start(customers, self.room[level], base, self.discount[level], rng))
            if level < context:
                customers = np.bincount(self.parents[level], weights=self.seats[level].tables).astype(np.int64)

    def probabilities(self) -> list[np.ndarray]:
        """Predictive probability of every gram of each level, by way of all shorter ones."""
        found: list[np.ndarray] = []
        for level in range(self.context, -1, -1):
            d, room, seats = self.discount[level], self.room[level], self.seats[level]
            customers = seats.customers()
            c, t = np.bincount(room, weights=customers), np.bincount(room, weights=seats.tables)
            parent = found[-1][self.parents[level]] if found else np.full(len(customers), 1.0 / SYMBOLS)
            found.append((customers - d * seats.tables + (STRENGTH + d * t[room]) * parent) / (STRENGTH + c[room]))
        return found[::-1]

    def sweep(self) -> None:
        """One Gibbs sweep over all levels, the longest contexts first."""
        p = self.probabilities()
        for level, seats in enumerate(self.seats):
            base = p[level + 1][self.parents[level]] if level < self.context else np.full(len(self.grams[level]), 1.0 / SYMBOLS)
            args = (self.room[level], np.bincount(self.room[level], weights=seats.tables), base, self.discount[level], self.rng)
            if level:
                wanted = np.bincount(self.parents[level - 1], weights=self.seats[level - 1].tables, minlength=len(seats.tables)).astype(np.int64)
                seats.become(wanted, *args)
            seats.sweep(*args)


def spell(words, grams: np.ndarray, logs: np.ndarray, context: int = CONTEXT) -> np.ndarray:
    """Probability of known words by the logarithms of their grams."""
    gram, size = events(words, context)
    at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    return np.exp(np.add.reduceat(logs[at], begin)) if len(size) else np.zeros(0)

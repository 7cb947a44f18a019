"""A price-time book of single orders, and the queue ahead of a virtual one."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import OrderedDict
from dataclasses import dataclass, field

#: The flag of top-of-book messages and the price that stands for none.
F_TOB = 64
UNDEF_PRICE = (1 << 63) - 1


class Invalid(Exception):
    """A message that doesn't fit the book; the book stays as it was."""


def _both(kind) -> dict:
    return field(default_factory=lambda: {"B": kind(), "A": kind()})


@dataclass
class Book:
    """sides: price to (order id to size, in order of priority). Top-of-book orders have no id and aren't looked up.

    The prices of a side are kept in order and the size of each level is kept, so
    that the best quotes after a message cost no look at the other levels.
    """

    sides: dict[str, dict[int, dict]] = _both(dict)
    prices: dict[str, list[int]] = _both(list)
    totals: dict[str, dict[int, int]] = _both(dict)
    placed: dict[int, tuple[str, int]] = field(default_factory=dict)

    def apply(self, action: str, side: str, price: int, size: int, order_id: int, flags: int = 0) -> None:
        if action in "TFN":
            return
        if action == "R":
            self._clear("B"), self._clear("A"), self.placed.clear()
            return
        if side not in ("A", "B"):
            raise Invalid(f"side {side}")
        if flags & F_TOB and price == UNDEF_PRICE:
            self._clear(side)
        elif action == "A":
            self._add(side, price, size, order_id, flags)
        elif action == "C":
            self._cancel(size, order_id)
        elif action == "M":
            self._modify(side, price, size, order_id, flags)
        else:
            raise Invalid(f"action {action}")

    def _clear(self, side: str) -> None:
        self.sides[side].clear(), self.prices[side].clear(), self.totals[side].clear()

    def _put(self, side: str, price: int, order_id: int | None, size: int) -> None:
        level = self.sides[side].get(price)
        if level is None:
            level = self.sides[side][price] = {}
            self.totals[side][price] = 0
            insort(self.prices[side], price)
        level[order_id] = size
        self.totals[side][price] += size

    def _take(self, side: str, price: int, level: dict, order_id: int) -> None:
        self.totals[side][price] -= level.pop(order_id)
        if not level:
            del self.sides[side][price], self.totals[side][price]
            del self.prices[side][bisect_left(self.prices[side], price)]

    def _add(self, side: str, price: int, size: int, order_id: int, flags: int) -> None:
        if flags & F_TOB:
            self._clear(side)
            self._put(side, price, None, size)
            return
        if order_id in self.placed:
            raise Invalid(f"order {order_id} is there")
        self._put(side, price, order_id, size)
        self.placed[order_id] = side, price

    def _where(self, order_id: int) -> tuple[str, int, dict]:
        side, price = self.placed.get(order_id, (None, None))
        level = self.sides[side].get(price, {}) if side else {}
        if order_id not in level:
            raise Invalid(f"no order {order_id}")
        return side, price, level

    def _cancel(self, size: int, order_id: int) -> None:
        side, price, level = self._where(order_id)
        if size > level[order_id]:
            raise Invalid(f"order {order_id} has less than {size}")
        level[order_id] -= size
        self.totals[side][price] -= size
        if not level[order_id]:
            self._take(side, price, level, order_id)
            del self.placed[order_id]

    def _modify(self, side: str, price: int, size: int, order_id: int, flags: int) -> None:
        if order_id not in self.placed:
            self._add(side, price, size, order_id, flags)
            return
        was, at, level = self._where(order_id)
        if was != side:
            raise Invalid(f"order {order_id} changed its side")
        if at == price and size <= level[order_id]:
            self.totals[side][price] += size - level[order_id]
            level[order_id] = size
            return
        self._take(was, at, level, order_id)
        self._put(side, price, order_id, size)
        self.placed[order_id] = side, price

    def best(self, side: str) -> int | None:
        prices = self.prices[side]
        return prices[-1 if side == "B" else 0] if prices else None

    def quotes(self) -> tuple:
        """Best bid, its size, best ask, its size."""
        bid, ask = self.best("B"), self.best("A")
        return bid, self.size("B", bid), ask, self.size("A", ask)

    def size(self, side: str, price: int | None) -> int | None:
        return None if price is None else self.totals[side].get(price, 0)

    def ahead(self, side: str, price: int) -> dict:
        """Orders that rest at a price, each with its size."""
        return {k: v for k, v in self.sides[side].get(price, {}).items() if v > 0 and k is not None}

    def position(self, order_id: int) -> int:
        """Size that rests before an order."""
        _, _, level = self._where(order_id)
        total = 0
        for other, size in level.items():
            if other == order_id:
                return total
            total += size
        return total

    def snapshot(self, levels: int) -> list[tuple]:
        """(bid, size, orders, ask, size, orders) of each level, None where a side has fewer."""
        bids, asks = self.prices["B"][::-1][:levels], self.prices["A"][:levels]

        def side(name: str, prices: list[int], k: int) -> tuple:
            return (prices[k], self.size(name, prices[k]), len([x for x in self.sides[name][prices[k]] if x is not None])) if k < len(prices) else (None, None, None)

        return [side("B", bids, k) + side("A", asks, k) for k in range(max(len(bids), len(asks)))]


@dataclass
class Queue:
    """What is ahead of a virtual order, by the orders that make it up."""

    left: int
    orders: dict

    def update(self, action: str, order_id: int, size: int) -> bool:
        """Take a message's effect; whether nothing is left ahead."""
        if self.left > 0 and order_id in self.orders:
            had = self.orders[order_id]
            if action in ("C", "F"):
                stays = had - min(size, had)
            elif action == "M":
                stays = size if size <= had else 0  # one that grows goes behind
            else:
                stays = had
            self.left -= had - stays
            if stays:
                self.orders[order_id] = stays
            else:
                del self.orders[order_id]
        return self.left <= 0


class _Level:
    """A price of a side: the virtual orders that queue there by number, and what holds them.

    ``held`` are the orders that rest there now, in the order in which they came; ``closed`` those that the book
    has otherwise since, each still ahead of the virtual orders that found it there.
    """

    __slots__ = "joined", "waiting", "held", "closed"

    def __init__(self) -> None:
        self.joined = 0
        self.waiting: OrderedDict[int, Ticket] = OrderedDict()
        self.held: OrderedDict[int, _Held] = OrderedDict()
        self.closed: dict[_Held, None] = {}


class _Held:
    """An order with the size that is ahead of the virtual orders numbered above ``since``, up to ``until`` once it is closed."""

    __slots__ = "level", "size", "since", "until", "watch"

    def __init__(self, level: _Level, size: int) -> None:
        self.level, self.size, self.since, self.until = level, size, level.joined, None
        self.watch: dict[int, Ticket] = {}


class Ticket:
    """The place of one virtual order in its level, and the closed order that it waits for, if it does."""

    __slots__ = "order", "level", "number", "after"

    def __init__(self, order: object, level: _Level) -> None:
        self.order, self.level, self.number, self.after = order, level, level.joined, None


class Queues:
    """What is ahead of every virtual order of a book, by the rules of ``Queue``, without a copy or a look for each.

    A virtual order waits for all orders that rested at its price when it came. These are known once, by the
    level: as long as the book and the queues agree on an order, it is ahead of all that came after it, so the
    first of a level tells which virtual orders have nothing ahead any more. Where they don't agree (a fill that
    the book hasn't seen, another price, a cleared side) the order is closed: it stays ahead of those that came
    before, and as the book has it it is another one for those that come after.
    """

    def __init__(self) -> None:
        self.levels: dict[tuple[str, int], _Level] = {}
        self.held: dict[int, _Held] = {}
        self.closed: dict[int, dict[_Held, None]] = {}

    def join(self, side: str, price: int, order: object) -> Ticket | None:
        """Queue a virtual order at a price; None if nothing rests there."""
        level = self.levels.get((side, price))
        if level is None or not level.held:
            return None
        level.joined += 1
        ticket = level.waiting[level.joined] = Ticket(order, level)
        return ticket

    def leave(self, ticket: Ticket) -> None:
        (ticket.after.watch if ticket.after else ticket.level.waiting).pop(ticket.number, None)

    def update(self, book: Book, action: str, order_id: int, size: int, flags: int = 0) -> list:
        """Take the effect of a message that ``book`` has taken already; the virtual orders with nothing ahead any more."""
        out: list = []
        if action in ("C", "F", "M"):
            mine = self.held.get(order_id)
            if mine is not None:
                self._less(mine, action, size)
            for old in list(self.closed.get(order_id, ())):
                self._less(old, action, size)
                if not old.size:
                    self._gone(order_id, old, out)
        if action == "R" or flags & F_TOB:
            for other in list(self.held):
                if other != order_id:
                    self._agree(book, other, out)
        if action not in ("T", "N"):
            self._agree(book, order_id, out)
        return out

    @staticmethod
    def _less(held: _Held, action: str, size: int) -> None:
        if action == "M":
            held.size = size if size <= held.size else 0  # one that grows goes behind
        else:
            held.size -= min(size, held.size)

    def _agree(self, book: Book, order_id: int, out: list) -> None:
        """Have those that come from now on find an order as the book has it."""
        where = book.placed.get(order_id)
        size = book.sides[where[0]].get(where[1], {}).get(order_id, 0) if where else 0
        held = self.held.get(order_id)
        if held is not None:
            if size and size == held.size and held.level is self.levels.get(where):
                return
            del self.held[order_id]
            level = held.level
            del level.held[order_id]
            if held.size and held.since < level.joined and level.waiting:
                held.until = level.joined
                level.closed[held] = None
                self.closed.setdefault(order_id, {})[held] = None
            self._advance(level, out)
        if size > 0:
            level = self.levels.get(where)
            if level is None:
                level = self.levels[where] = _Level()
            self.held[order_id] = level.held[order_id] = _Held(level, size)

    def _advance(self, level: _Level, out: list) -> None:
        """Let go of the virtual orders of a level that came before all that rests there now."""
        first = next(iter(level.held.values())).since if level.held else level.joined
        while level.waiting:
            number = next(iter(level.waiting))
            if number > first:
                return
            self._wait(level.waiting.pop(number), out)

    def _wait(self, ticket: Ticket, out: list) -> None:
        """Have a virtual order wait for a closed order that is ahead of it; without one it has nothing ahead."""
        ticket.after = next((x for x in ticket.level.closed if x.since < ticket.number <= x.until), None)
        if ticket.after is None:
            out.append(ticket.order)
        else:
            ticket.after.watch[ticket.number] = ticket

    def _gone(self, order_id: int, old: _Held, out: list) -> None:
        del self.closed[order_id][old], old.level.closed[old]
        if not self.closed[order_id]:
            del self.closed[order_id]
        for ticket in old.watch.values():
            self._wait(ticket, out)

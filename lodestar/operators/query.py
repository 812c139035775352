"""Queries: a DataFrame, the columns that show, and the order of its elements.

Every operator returns a new Query; nothing runs before a terminal. A scan's elements stand in the
order of their files and rows, carried in two hidden columns that Catalyst prunes where no operator
needs them. Terminals come twice: ``frame_...`` gives a one-row DataFrame, the plain name a value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.expressions import Expr, Row, of
from lodestar.plans.order import Key, cut, numbered, sort

FILE, PLACE = "__file", "__place"
#: Hidden columns that hold the order of elements of several scans: of left, right, groups.
CARRIED = "__c_"
#: Hidden columns that number elements or hold their place in a file: no two elements have the same.
UNIQUE = {PLACE, "__n", "__at"}
SCAN_ORDER: tuple[Key, ...] = ((FILE, False), (PLACE, False))


class EmptyError(ValueError):
    """A terminal that needs an element found none."""


class ManyError(ValueError):
    """A terminal that takes one element found several."""


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__")]


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


class Query:
    def __init__(self, df: DataFrame | Callable[[bool], DataFrame], columns: Sequence[str] | None = None, order: Sequence[Key] = (), explicit: int = 0, root: Any = None, filters: Sequence[Callable] = ()):
        """``df``: a DataFrame, or a function that makes it with (True) or without the scan's order."""
        self._make = df if callable(df) else lambda ordered: df
        self._made: dict[bool, DataFrame] = {}
        self.columns = list(columns if columns is not None else visible(self._lean))
        self._order, self._explicit = tuple(order), explicit
        self._root, self._filters = root, tuple(filters)  # the table and its filters, while there is nothing else

    # plumbing
    def _frame_of(self, ordered: bool) -> DataFrame:
        if ordered not in self._made:
            self._made[ordered] = self._make(ordered)
        return self._made[ordered]

    @property
    def _df(self) -> DataFrame:
        """With the hidden columns of the order."""
        return self._frame_of(True)

    @property
    def _lean(self) -> DataFrame:
        """Without those of the scan, which would cost every scan a little."""
        return self._frame_of(False)

    def _next(self, df, columns=None, order=None, explicit: int | None = None, **scan) -> Query:
        return Query(df, self.columns if columns is None else columns, self._order if order is None else order, self._explicit if explicit is None else explicit, **scan)

    def _row(self) -> Row:
        return Row(self.columns)

    def _expr(self, what: Any) -> Expr:
        """A property's name, a function of the row, an Expr or a Column."""
        if isinstance(what, str):
            return self._row()[what]
        return of(what(self._row()) if callable(what) and not isinstance(what, Column) else what)

    def _condition(self, what: Any) -> Expr:
        found = self._expr(what)
        typed = self._lean if self._root is None else self._root._lean
        kind = typed.select(found.col.alias("c")).schema["c"].dataType.simpleString()
        if kind != "boolean":
            raise TypeError(f"a condition is boolean, not {kind}")
        return found

    def _hidden(self, ordered: bool = True) -> list[str]:
        return list(dict.fromkeys(c for c, _ in self._order if c not in self.columns and (ordered or not (c in (FILE, PLACE) or c.startswith(CARRIED)))))

    def _carried(self, tag: str, names: Sequence[Column] | None = None) -> tuple[Callable[..., DataFrame], list[Key]]:
        """A function that makes the frame of visible columns (or ``names``) and its order under other names, and that order."""
        order = [(f"{CARRIED}{tag}{k}", down) for k, (_, down) in enumerate(self._order)]

        def made(*more: Column) -> DataFrame:
            keys = [F.col(c).alias(new) for (c, _), (new, _) in zip(self._order, order)]
            return self._df.select(*(map(quoted, self.columns) if names is None else names), *more, *keys)

        return made, order

    def _keyed(self, what: Any) -> tuple[list[str], list[Column]]:
        """Names and columns of keys: one or several names, functions, or a dict of them."""
        if isinstance(what, dict):
            return list(what), [self._expr(v).col for v in what.values()]
        items = list(what) if isinstance(what, (list, tuple)) else [what]
        return [w if isinstance(w, str) else f"key{k or ''}" for k, w in enumerate(items)], [self._expr(w).col for w in items]

    def to_df(self, ordered: bool = False) -> DataFrame:
        df = self._df.orderBy(*sort(self._order)) if self._order and (ordered or self._explicit) else self._lean
        return df.select(*map(quoted, self.columns))

    def explain(self, mode: str = "formatted") -> None:
        self.to_df().explain(mode)

    # filters and projections
    def where(self, condition: Any) -> Query:
        found = self._condition(condition)
        if self._root is None:
            return self._next(lambda o: self._frame_of(o).where(found.col))
        root, filters = self._root, (*self._filters, condition)
        every = [self._condition(f) for f in filters]
        bounds = tuple(b for e in every for b in e.bounds)
        return self._next(lambda o: reduce(lambda df, e: df.where(e.col), every, root.within(bounds, o)), root=root, filters=filters)

    def select(self, *items: Any, **named: Any) -> Query:
        """Properties by name, and computed or renamed ones by keyword."""
        columns = {n if isinstance(n, str) else f"item{k}": self._expr(n) for k, n in enumerate(items)} | {n: self._expr(v) for n, v in named.items()}
        return self._next(lambda o: self._frame_of(o).select(*[e.col.alias(n) for n, e in columns.items()], *self._hidden(o)), list(columns))

    def select_many(self, what: Any, name: str = "item") -> Query:
        """An element for each member of an array."""
        df = self._df.select(*map(quoted, self.columns), *self._hidden(), F.posexplode(self._expr(what).col).alias("__member", name))
        n = f"__k{len(self._order)}m"
        return self._next(df.withColumnRenamed("__member", n), [*self.columns, name], (*self._order, (n, False)) if self._order else ())

    def cast(self, **kinds: str) -> Query:
        return self.select(**{c: (lambda r, c=c: r[c].cast(kinds[c]) if c in kinds else r[c]) for c in self.columns})

    def of_type(self, **kinds: str) -> Query:
        """Elements whose columns cast to the kinds, cast."""
        tried = {c: quoted(c).try_cast(k) for c, k in kinds.items()}
        fit = " and ".join(f"try_cast(`{c}` as {k}) is not null" for c, k in kinds.items())
        return self._next(lambda o: self._frame_of(o).where(fit).withColumns(tried))

    # order
    def _sorted_by(self, keys: Sequence[Any], down: bool, then: bool) -> Query:
        made = {f"__k{len(self._order) + k}": self._expr(what).col for k, what in enumerate(keys)}
        added = [(name, down) for name in made]

        def df(o: bool) -> DataFrame:
            return self._frame_of(o).withColumns(made)

        if then:
            if not self._explicit:
                raise TypeError("then_by follows order_by")
            return self._next(df, order=(*self._order[: self._explicit], *added, *self._order[self._explicit :]), explicit=self._explicit + len(added))
        return self._next(df, order=(*added, *self._order), explicit=len(added))

    def order_by(self, *keys: Any) -> Query:
        """Stable ascending order, nulls first; by all columns without keys."""
        return self._sorted_by(keys or self.columns, False, False)

    def order_by_desc(self, *keys: Any) -> Query:
        return self._sorted_by(keys or self.columns, True, False)

    def then_by(self, *keys: Any) -> Query:
        return self._sorted_by(keys, False, True)

    def then_by_desc(self, *keys: Any) -> Query:
        return self._sorted_by(keys, True, True)

    def reverse(self) -> Query:
        keys = self._total()
        return self._next(self._make, order=[(c, not down) for c, down in keys], explicit=len(keys))

    def shuffle(self, seed: int | None = None) -> Query:
        return self._sorted_by([F.rand(seed)], False, False)

    def _total(self) -> tuple[Key, ...]:
        """The order, or for elements without one that of their values."""
        return self._order or tuple((c, False) for c in self.columns)

    # parts of the order
    def take(self, n: int) -> Query:
        whole = self._root is not None and not self._filters
        base = self._root.leading(n) if whole else self._df
        return self._next(base.orderBy(*sort(self._total())).limit(max(0, n)))

    def skip(self, n: int) -> Query:
        """Elements after the n first ones, by the key of the last of those: no global sort.

        Where keys may be equal, elements are numbered instead.
        """
        if n <= 0:
            return self
        keys = self._total()
        if UNIQUE.isdisjoint(c for c, _ in keys) or any(c.startswith(CARRIED) for c, _ in keys):
            return self._next(numbered(self._df, keys, "__number").where(F.col("__number") >= n).drop("__number"))
        head = self._df.orderBy(*sort(keys)).limit(n)
        edge = head.orderBy(*sort(keys, flip=True)).limit(1)
        full = head.agg(F.count("*").alias("n")).where(F.col("n") >= n).select("n")
        return self._next(cut(self._df, keys, edge.join(full, F.lit(True)).drop("n"), False, False, inclusive=False))

    def page(self, skip: int, take: int) -> Query:
        return self._next(self._df.orderBy(*sort(self._total())).offset(skip).limit(take))

    def take_last(self, n: int) -> Query:
        return self._next(self._df.orderBy(*sort(self._total(), flip=True)).limit(max(0, n)))

    def skip_last(self, n: int) -> Query:
        return self.reverse().skip(n)._restored(self)

    def _restored(self, other: Query) -> Query:
        return self._next(self._make, order=other._order, explicit=other._explicit)

    def _first_failure(self, condition: Any) -> DataFrame:
        keys = self._total()
        fails = self._df.where(~F.coalesce(self._condition(condition).col, F.lit(False)))
        return fails.orderBy(*sort(keys)).limit(1)

    def take_while(self, condition: Any) -> Query:
        return self._next(cut(self._df, self._total(), self._first_failure(condition), True, True))

    def skip_while(self, condition: Any) -> Query:
        return self._next(cut(self._df, self._total(), self._first_failure(condition), False, False))

    def take_range(self, start: int, stop: int | None = None) -> Query:
        """Elements from ``start`` up to before ``stop``; negative places count from the end."""
        found = self.skip(start) if start >= 0 else self.take_last(-start)._restored(self)
        if stop is None:
            return found
        if stop < 0:
            return found.skip_last(-stop)
        if start < 0:
            raise ValueError("a place from the end can't be followed by one from the beginning")
        return self.page(start, max(0, stop - start))

    def _with_number(self, apply: Callable[[Query, Callable], Query], condition: Callable) -> Query:
        numbered_ = self.index("__i")
        return apply(numbered_, lambda r: condition(r, r["__i"]))._only(self.columns)

    def where_indexed(self, condition: Callable[[Row, Expr], Any]) -> Query:
        """Elements for which a condition of the element and its number holds."""
        return self._with_number(Query.where, condition)

    def take_while_indexed(self, condition: Callable[[Row, Expr], Any]) -> Query:
        return self._with_number(Query.take_while, condition)

    def skip_while_indexed(self, condition: Callable[[Row, Expr], Any]) -> Query:
        return self._with_number(Query.skip_while, condition)

    def index(self, name: str = "index") -> Query:
        """Adds each element's number from 0."""
        df = numbered(self._df, self._total(), name).withColumn("__n", F.col(name))
        return Query(df, [*self.columns, name], [("__n", False)])

    def chunk(self, size: int, name: str = "chunk") -> Query:
        """Adds the number of the chunk of ``size`` elements that each belongs to."""
        return self.index("__at").select(*self.columns, **{name: lambda r: F.floor(F.col("__at") / size)})._only(self.columns, name)

    def _only(self, columns: Sequence[str], *more: str) -> Query:
        return self._next(self._make, [*columns, *more])

    def zip(self, other: Query, **names: str) -> Query:
        """Pairs by number; columns of the other may be renamed by keyword new=old."""
        right = other.select(**(names or {c: c for c in other.columns})).index("__at")
        left = self.index("__at")
        both = left._df.join(right._df.select("__at", *map(quoted, right.columns[:-1])), "__at")
        return Query(both, [*self.columns, *right.columns[:-1]], [("__at", False)])

    # sets
    def distinct(self) -> Query:
        """In the order of first occurrences; elements without an order have none."""
        columns = [*map(quoted, self.columns)]
        if not self._order or any(down for _, down in self._order):
            return Query(self._plain().distinct(), self.columns)
        order = [f"{CARRIED}d{k}" for k in range(len(self._order))]

        def made(o: bool) -> DataFrame:
            if not o:
                return self._plain().distinct()
            found = self._df.groupBy(*columns).agg(F.min(F.struct(*[F.col(c).alias(new) for (c, _), new in zip(self._order, order)])).alias("__first"))
            return found.select(*columns, *[F.col(f"__first.{c}").alias(c) for c in order])

        return Query(made, self.columns, [(c, False) for c in order], len(order) if self._explicit else 0)

    def distinct_by(self, key: Any) -> Query:
        """The first element of each key: an aggregate, so a frequent key is combined before it moves."""
        keys = self._total()
        _, columns = self._keyed(key)
        if any(down for _, down in keys):
            from pyspark.sql.window import Window

            rank = F.row_number().over(Window.partitionBy(*columns).orderBy(*sort(keys)))
            return self._next(self._df.withColumn("__rank", rank).where("__rank = 1").drop("__rank"))
        whole = F.struct(*map(quoted, self._df.columns))
        first = self._df.groupBy(*[c.alias(f"__by{k}") for k, c in enumerate(columns)]).agg(F.min_by(whole, F.struct(*[F.col(c).alias(f"k{i}") for i, (c, _) in enumerate(keys)])).alias("__first"))
        return self._next(first.select("__first.*"))

    def _plain(self) -> DataFrame:
        return self._lean.select(*map(quoted, self.columns))

    def concat(self, other: Query) -> Query:
        """This query's elements, then the other's, each in their order."""
        (left, left_order), (right, right_order) = self._carried("l"), other._carried("r")
        side = f"{CARRIED}side"

        def made(o: bool) -> DataFrame:
            if not o:
                return self._plain().unionByName(other._plain())
            return left(F.lit(0).alias(side)).unionByName(right(F.lit(1).alias(side)), allowMissingColumns=True)

        order = [(side, False), *left_order, *right_order]
        return Query(made, self.columns, order, len(order) if self._explicit or other._explicit else 0)

    def union(self, other: Query) -> Query:
        return self.concat(other).distinct()

    def _among(self, other: Query, how: str, plain: DataFrame) -> Query:
        """Distinct elements that the other holds, or doesn't, in this query's order."""
        first = self.distinct()
        if not first._order:
            return Query(plain, self.columns)

        def made(o: bool) -> DataFrame:
            if not o:
                return plain
            right = other._plain().select(*[quoted(c).alias(f"__other{k}") for k, c in enumerate(self.columns)])
            same = F.lit(True)
            for k, c in enumerate(self.columns):
                same = same & quoted(c).eqNullSafe(F.col(f"__other{k}"))
            return first._df.join(right, same, how)

        return Query(made, self.columns, first._order, first._explicit)

    def intersect(self, other: Query) -> Query:
        return self._among(other, "left_semi", self._plain().intersect(other._plain().select(*map(quoted, self.columns))))

    def except_(self, other: Query) -> Query:
        return self._among(other, "left_anti", self._plain().subtract(other._plain().select(*map(quoted, self.columns))))

    def union_by(self, other: Query, key: Any) -> Query:
        """First elements of each key, those of this query before the other's."""
        return self.concat(other).distinct_by(key)

    def _by_keys(self, keys: Query, key: Any, how: str) -> Query:
        first = self.distinct_by(key)
        _, columns = first._keyed(key)
        df = first._df
        for k, c in enumerate(columns):
            df = df.withColumn(f"__by{k}", c)
        right = keys._plain().toDF(*[f"__other{k}" for k in range(len(keys.columns))])
        same = F.lit(True)
        for k in range(len(columns)):
            same = same & F.col(f"__by{k}").eqNullSafe(F.col(f"__other{k}"))
        return self._next(df.join(right, same, how))

    def intersect_by(self, keys: Query, key: Any) -> Query:
        """First elements of each key that ``keys``, a query of as many columns, holds."""
        return self._by_keys(keys, key, "left_semi")

    def except_by(self, keys: Query, key: Any) -> Query:
        return self._by_keys(keys, key, "left_anti")

    def _literal(self, values: dict[str, Any]) -> DataFrame:
        schema = self._plain().schema
        return self._df.sparkSession.createDataFrame([tuple(values.get(f.name) for f in schema.fields)], schema)

    def append(self, **values: Any) -> Query:
        return self._added(values, 1)

    def prepend(self, **values: Any) -> Query:
        return self._added(values, -1)

    def _added(self, values: dict[str, Any], side: int) -> Query:
        old = self._df.withColumn("__side", F.lit(0))
        new = self._literal(values).withColumn("__side", F.lit(side))
        return Query(old.unionByName(new, allowMissingColumns=True), self.columns, [("__side", False), *self._order], 1)

    def default_if_empty(self, **values: Any) -> Query:
        return Query(self._plain().unionByName(self._literal(values).join(self._plain().limit(1).select(F.lit(1).alias("__any")), F.lit(True), "left_anti")), self.columns)

    # joins
    def _join(self, other: Query, left_key: Any, right_key: Any, how: str, names: dict[str, str] | None) -> Query:
        names = names or {c: c for c in other.columns if c not in self.columns}
        _, left_keys = self._keyed(left_key)
        _, right_keys = other._keyed(right_key)
        renamed = [quoted(old).alias(new) for new, old in names.items()]
        left_more, right_more = ([c.alias(f"__{side}{k}") for k, c in enumerate(found)] for side, found in (("l", left_keys), ("r", right_keys)))
        (left, left_order), (right, right_order) = self._carried("l"), other._carried("r", renamed)
        on = reduce(lambda a, b: a & b, [F.col(f"__l{k}") == F.col(f"__r{k}") for k in range(len(left_keys))])
        one_sided = how in ("left_semi", "left_anti")
        columns = self.columns if one_sided else [*self.columns, *names]
        order = left_order if one_sided else [*right_order, *left_order] if how == "right" else [*left_order, *right_order]

        def made(o: bool) -> DataFrame:
            if o:
                return left(*left_more).join(right(*right_more), on, how).select(*map(quoted, columns), *[c for c, _ in order])
            return self._plain().select("*", *left_more).join(other._plain().select(*renamed, *right_more), on, how).select(*map(quoted, columns))

        return Query(made, columns, order, len(order) if self._explicit else 0)

    def join(self, other: Query, left_key: Any, right_key: Any, how: str = "inner", names: dict[str, str] | None = None) -> Query:
        """Equi-join; null keys never match. ``names``: the other's columns as new=old, by default all new ones.

        Elements stand in this query's order, matches of one in the other's.
        """
        return self._join(other, left_key, right_key, how, names)

    def left_join(self, other: Query, left_key: Any, right_key: Any, names: dict[str, str] | None = None) -> Query:
        return self._join(other, left_key, right_key, "left", names)

    def right_join(self, other: Query, left_key: Any, right_key: Any, names: dict[str, str] | None = None) -> Query:
        return self._join(other, left_key, right_key, "right", names)

    def semi_join(self, other: Query, left_key: Any, right_key: Any) -> Query:
        return self._join(other, left_key, right_key, "left_semi", None)

    def anti_join(self, other: Query, left_key: Any, right_key: Any) -> Query:
        return self._join(other, left_key, right_key, "left_anti", None)

    def group_join(self, other: Query, left_key: Any, right_key: Any, **aggregates: Any) -> Query:
        """Each element with aggregates (functions of a Group) of the other's matches; none match: of nothing.

        Aggregates run before the join, so only a row per key meets the elements.
        """
        _, right_keys = other._keyed(right_key)
        _, left_keys = self._keyed(left_key)
        group = Group(other, [], [])
        named = {n: f(group) for n, f in aggregates.items()}
        right = other._plain().select("*", *[c.alias(f"__r{k}") for k, c in enumerate(right_keys)]).groupBy(*[f"__r{k}" for k in range(len(right_keys))])
        right = right.agg(*[a.col.alias(n) for n, a in named.items()])
        left = self._plain().select("*", *[c.alias(f"__l{k}") for k, c in enumerate(left_keys)])
        on = [F.col(f"__l{k}") == F.col(f"__r{k}") for k in range(len(left_keys))]
        filled = [F.coalesce(quoted(n), a.empty).alias(n) if a.empty is not None else quoted(n) for n, a in named.items()]
        return Query(left.join(right, on, "left").select(*map(quoted, self.columns), *filled), [*self.columns, *named])

    def cross_join(self, other: Query, names: dict[str, str] | None = None, on: Callable[[Row, Row], Any] | None = None) -> Query:
        """All pairs, or those for which ``on`` (of both rows) holds."""
        names = names or {c: c for c in other.columns if c not in self.columns}
        right = other._plain().select(*[quoted(old).alias(new) for new, old in names.items()])
        left = self._plain()
        if on is None:
            return Query(left.crossJoin(right), [*self.columns, *names])
        return Query(left.join(right, of(on(Row(self.columns), Row(names))).col), [*self.columns, *names])

    # groups
    def group_by(self, *keys: Any, **named: Any) -> Group:
        """Null keys are a group."""
        names, columns = self._keyed(list(keys))
        return Group(self, [*names, *named], [*columns, *(self._expr(v).col for v in named.values())])

    def count_by(self, *keys: Any, name: str = "n") -> Query:
        return self.group_by(*keys).agg(**{name: lambda g: g.count()})

    def aggregate_by(self, *keys: Any, seed: Any, step: Callable[[Column, Column], Column], of: Any, name: str = "value") -> Query:
        return self.group_by(*keys).agg(**{name: lambda g: g.fold(of, seed, step)})

    # terminals
    def frame(self, **aggregates: Callable[[Group], Any]) -> DataFrame:
        """One row of aggregates of all elements."""
        group = Group(self, [], [])
        found = {n: f(group) for n, f in aggregates.items()}
        base = self._df if any(a.ordered for a in found.values()) else self._lean
        return base.agg(*[(F.coalesce(a.col, a.empty) if a.empty is not None else a.col).alias(n) for n, a in found.items()])

    def _value(self, make: Callable[[Group], Any]) -> Any:
        return self.frame(value=make).first()[0]

    def _needed(self, make: Callable[[Group], Any], nullable: bool) -> Any:
        row = self.frame(value=make, n=lambda g: g.count()).first()
        if row["n"] == 0 and not nullable:
            raise EmptyError("no elements")
        return row["value"]

    def count(self, condition: Any = None) -> int:
        query = self if condition is None else self.where(condition)
        if query._root is not None:
            indexed = query._root.indexed_count(query._filters)
            if indexed is not None:
                return indexed
        return query._lean.count()

    long_count = count

    def frame_count(self, condition: Any = None, name: str = "n") -> DataFrame:
        query = self if condition is None else self.where(condition)
        return query._lean.agg(F.count("*").alias(name))

    def sum(self, what: Any) -> Any:
        """0 of no elements; nulls don't count."""
        return self._value(lambda g: g.sum(what))

    def average(self, what: Any, nullable: bool = False) -> Any:
        return self._needed(lambda g: g.average(what), nullable)

    def min(self, what: Any, nullable: bool = False) -> Any:
        return self._needed(lambda g: g.min(what), nullable)

    def max(self, what: Any, nullable: bool = False) -> Any:
        return self._needed(lambda g: g.max(what), nullable)

    def aggregate(self, of_: Any, seed: Any, step: Callable[[Column, Column], Column]) -> Any:
        return self._value(lambda g: g.fold(of_, seed, step))

    def reduce(self, of_: Any, step: Callable[[Column, Column], Column]) -> Any:
        """Fold from the first value on; of nothing it raises."""
        return self._needed(lambda g: g.reduce(of_, step), False)

    def min_by(self, key: Any) -> Query:
        """The element of the least key (not null), the first of several."""
        return self._by_extreme(key, False)

    def max_by(self, key: Any) -> Query:
        return self._by_extreme(key, True)

    def _by_extreme(self, key: Any, down: bool) -> Query:
        column = self._expr(key).col
        return self._next(self._df.where(column.isNotNull()).withColumn("__by", column).orderBy(*sort([("__by", down), *self._total()])).limit(1).drop("__by"))

    def frame_any(self, condition: Any = None, name: str = "result") -> DataFrame:
        query = self if condition is None else self.where(condition)
        return query._lean.limit(1).agg((F.count("*") > 0).alias(name))

    def any(self, condition: Any = None) -> bool:
        return not (self if condition is None else self.where(condition))._lean.isEmpty()

    def frame_all(self, condition: Any, name: str = "result") -> DataFrame:
        """Whether no element fails; a null condition fails."""
        fails = self._lean.where(~F.coalesce(self._condition(condition).col, F.lit(False)))
        return fails.limit(1).agg((F.count("*") == 0).alias(name))

    def all(self, condition: Any) -> bool:
        return self.frame_all(condition).first()[0]

    def contains(self, **values: Any) -> bool:
        return self.any(self._equal(values))

    def frame_contains(self, name: str = "result", **values: Any) -> DataFrame:
        return self.frame_any(self._equal(values), name)

    def _equal(self, values: dict[str, Any]) -> Column:
        same = F.lit(True)
        for c in self.columns:
            same = same & quoted(c).eqNullSafe(F.lit(values.get(c)))
        return same

    def frame_first(self, condition: Any = None) -> DataFrame:
        return (self if condition is None else self.where(condition)).take(1)._plain()

    def frame_last(self, condition: Any = None) -> DataFrame:
        return (self if condition is None else self.where(condition)).take_last(1)._plain()

    def frame_element_at(self, n: int) -> DataFrame:
        return self.page(n, 1)._plain()

    @staticmethod
    def _one(rows: list, what: str) -> Any:
        if not rows:
            raise EmptyError(what)
        return rows[0]

    def first(self, condition: Any = None) -> Any:
        return self._one(self.frame_first(condition).collect(), "no elements")

    def first_or_default(self, condition: Any = None, default: Any = None) -> Any:
        return next(iter(self.frame_first(condition).collect()), default)

    def last(self, condition: Any = None) -> Any:
        return self._one(self.frame_last(condition).collect(), "no elements")

    def last_or_default(self, condition: Any = None, default: Any = None) -> Any:
        return next(iter(self.frame_last(condition).collect()), default)

    def _at_most_one(self, condition: Any) -> list:
        rows = (self if condition is None else self.where(condition))._plain().limit(2).collect()
        if len(rows) > 1:
            raise ManyError("more than one element")
        return rows

    def single(self, condition: Any = None) -> Any:
        return self._one(self._at_most_one(condition), "no elements")

    def single_or_default(self, condition: Any = None, default: Any = None) -> Any:
        return next(iter(self._at_most_one(condition)), default)

    def element_at(self, n: int) -> Any:
        return self._one(self.frame_element_at(n).collect(), f"no element {n}")

    def element_at_or_default(self, n: int, default: Any = None) -> Any:
        return next(iter(self.frame_element_at(n).collect()), default)

    def sequence_equal(self, other: Query) -> bool:
        if len(self.columns) != len(other.columns):
            return False
        left, right = self.index("__at")._df, other.index("__at")._df
        a = left.select("__at", F.struct(*map(quoted, self.columns)).alias("__a"))
        b = right.select("__at", F.struct(*map(quoted, other.columns)).alias("__b")).withColumn("__there", F.lit(True))
        joined = a.withColumn("__here", F.lit(True)).join(b, "__at", "full")
        same = F.col("__here").isNotNull() & F.col("__there").isNotNull() & F.col("__a").eqNullSafe(F.col("__b"))
        return joined.where(~same).isEmpty()

    def to_list(self) -> list:
        return self.to_df(ordered=True).collect()

    def __iter__(self) -> Iterator:
        """Elements one partition at a time."""
        return self.to_df(ordered=True).toLocalIterator()

    def to_pandas(self):
        return self.to_df(ordered=True).toPandas()

    def to_dict(self, key: Any, value: Any = None) -> dict:
        found: dict = {}
        item = F.struct(*map(quoted, self.columns)) if value is None else self._expr(value).col
        for k, v in self._lean.select(self._expr(key).col, item).collect():
            if k in found:
                raise ValueError(f"repeated key {k!r}")
            found[k] = v
        return found

    def to_lookup(self, key: Any, value: Any = None) -> dict[Any, list]:
        found: dict = {}
        item = F.struct(*map(quoted, self.columns)) if value is None else self._expr(value).col
        ordered = self._df.orderBy(*sort(self._total()))
        for k, v in ordered.select(self._expr(key).col, item).collect():
            found.setdefault(k, []).append(v)
        return found


def in_turn(downs: Sequence[bool]) -> Callable[[Column, Column], Column]:
    """A comparator of structs k0, k1, ... of which some descend; nulls are lowest."""

    def compare(x: Column, y: Column) -> Column:
        found = F.lit(0)
        for k, down in reversed(list(enumerate(downs))):
            a, b = (y[f"k{k}"], x[f"k{k}"]) if down else (x[f"k{k}"], y[f"k{k}"])
            less = F.coalesce(a < b, a.isNull() & b.isNotNull())
            found = F.when(a.eqNullSafe(b), found).when(less, F.lit(-1)).otherwise(F.lit(1))
        return found

    return compare


class Aggregate:
    """An aggregate column, and its value for no elements where that isn't null."""

    def __init__(self, col: Column, empty: Column | None = None, ordered: bool = False):
        self.col, self.empty, self.ordered = col, empty, ordered


class Group:
    """Elements by key. ``agg`` takes functions of this object: ``agg(n=lambda g: g.count())``."""

    def __init__(self, query: Query, names: Sequence[str], keys: Sequence[Column]):
        self._query, self.names, self._keys = query, list(names), list(keys)

    def count(self, condition: Any = None) -> Aggregate:
        if condition is None:
            return Aggregate(F.count("*"), F.lit(0).cast("long"))
        return Aggregate(F.count_if(self._query._condition(condition).settled()), F.lit(0).cast("long"))

    def count_distinct(self, what: Any) -> Aggregate:
        return Aggregate(F.count_distinct(self._query._expr(what).col), F.lit(0).cast("long"))

    def sum(self, what: Any) -> Aggregate:
        total = F.sum(self._query._expr(what).col)
        return Aggregate(F.coalesce(total, F.lit(0)), F.lit(0))

    def average(self, what: Any) -> Aggregate:
        return Aggregate(F.avg(self._query._expr(what).col))

    def min(self, what: Any) -> Aggregate:
        return Aggregate(F.min(self._query._expr(what).col))

    def max(self, what: Any) -> Aggregate:
        return Aggregate(F.max(self._query._expr(what).col))

    def min_by(self, what: Any, key: Any) -> Aggregate:
        """``what`` of the element with the least key; of several, the least."""
        value, by = self._query._expr(what).col, self._query._expr(key).col
        return Aggregate(F.min_by(value, F.struct(by, value)))

    def max_by(self, what: Any, key: Any) -> Aggregate:
        """``what`` of the element with the greatest key; of several, the greatest."""
        value, by = self._query._expr(what).col, self._query._expr(key).col
        return Aggregate(F.max_by(value, F.struct(by, value)))

    def items(self, what: Any = None) -> Aggregate:
        """The elements, or a value of each, as an array in their values' order; its size is the group's."""
        value = F.struct(*map(quoted, self._query.columns)) if what is None else self._query._expr(what).col
        return Aggregate(F.sort_array(F.collect_list(value)), F.array())

    def _values(self, what: Any) -> tuple[Column, bool]:
        """The values as an array in their order, and whether that needs the hidden columns."""
        keys, value = self._query._order, self._query._expr(what).col
        if not keys:
            return F.sort_array(F.collect_list(value)), False
        pairs = F.collect_list(F.struct(*[F.col(c).alias(f"k{i}") for i, (c, _) in enumerate(keys)], value.alias("v")))
        pairs = F.array_sort(pairs, in_turn([down for _, down in keys])) if any(down for _, down in keys) else F.sort_array(pairs)
        return F.transform(pairs, lambda p: p["v"]), True

    def fold(self, what: Any, seed: Any, step: Callable[[Column, Column], Column]) -> Aggregate:
        """Fold the values, in their order, from a seed."""
        first = seed if isinstance(seed, Column) else F.lit(seed)
        values, ordered = self._values(what)
        return Aggregate(F.aggregate(values, first, step), first, ordered=ordered)

    def reduce(self, what: Any, step: Callable[[Column, Column], Column]) -> Aggregate:
        """Fold the values, in their order, from the first one; null of nothing."""
        values, ordered = self._values(what)
        return Aggregate(F.aggregate(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.get(values, F.lit(0)), step), ordered=ordered)

    def agg(self, **aggregates: Callable[[Group], Aggregate]) -> Query:
        found = {n: f(self) for n, f in aggregates.items()}
        base = self._query._df if any(a.ordered for a in found.values()) else self._query._lean
        keys = self._query._order
        made = [a.col.alias(n) for n, a in found.items()] or [F.lit(1).alias("__one")]
        by = [c.alias(n) for n, c in zip(self.names, self._keys)]
        if not keys or any(down for _, down in keys):
            return Query(base.groupBy(*by).agg(*made), [*self.names, *found])
        first = f"{CARRIED}g"  # groups stand in the order of their first elements

        def frame(o: bool) -> DataFrame:
            more = [F.min(F.struct(*[F.col(c).alias(f"k{i}") for i, (c, _) in enumerate(keys)])).alias(first)] if o else []
            return (self._query._df if o else base).groupBy(*by).agg(*made, *more)

        return Query(frame, [*self.names, *found], [(first, False)])

    def keys(self) -> Query:
        return Query(self._query._lean.select(*[c.alias(n) for n, c in zip(self.names, self._keys)]).distinct(), self.names)

    def number(self) -> int:
        return self.keys()._lean.count()

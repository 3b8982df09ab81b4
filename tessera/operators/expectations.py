"""Data-quality expectations compiled into a single aggregate.

A suite is a list of rules. Each rule contributes aggregate expressions to
ONE ``df.agg(...)`` over the table, and turns that single result row into
its report row ``(rule_id, expectation_type, column, success,
observed_value, details)``. Rules about the schema (column present, type)
are decided on the driver from ``df.schema`` and cost nothing. The value
lists of in-set rules come from one extra distributed pass shared by all of
them (never a set of a whole column collected into one task).

Each rule can also write itself as SQL (``sql_row``), which is how the
DuckDB oracle checks the same suite independently.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import expressions as E
from ..session import ensure_checkpoint_dir


def _py(v) -> str:
    """Python's text for a bound (None, 0, 0.0, 200.0)."""
    return str(v)


def _pylist_spark(arr: Column) -> Column:
    """Python ``str(sorted list of str)`` for a Spark string array."""
    # ['a', 'b']: join with "', '" and wrap; an empty list prints as []
    return F.when(F.size(arr) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("['"), F.array_join(arr, "', '"), F.lit("']")))


def _listing(arr: str, n: str) -> Column:
    """Text of the listed values in array column ``arr``, and how many more
    there are when the list was cut at ``LIST_VALUES`` (``n`` holds the exact
    number of distinct values). One SQL expression: one driver round trip."""
    text = (f"case when size({arr}) = 0 then '[]' "
            f"else concat('[\\'', array_join({arr}, '\\', \\''), '\\']') end")
    return F.expr(f"case when {n} > size({arr}) then concat({text}, ' + ', "
                  f"cast({n} - size({arr}) as string), ' more') else {text} end")


# Distinct values printed per list (every distinct value is
# counted here, and listed without a limit by ``suite_values``), and hash
# slices a column's values are ranked in first.
LIST_VALUES = 1000
LIST_SLICES = 64


def _value_lists(df: DataFrame, rules: list) -> DataFrame:
    """One row: per in-set rule the sorted distinct values seen and the
    unexpected ones (the first ``LIST_VALUES`` of each) with exact counts.

    All rule columns are unpivoted into one ``groupBy(rule, value)``, so
    distinct values are found by a distributed aggregate whose partial phase
    absorbs hot values. The smallest values are ranked first inside
    ``LIST_SLICES`` hash slices of each rule and then across the survivors,
    so no task ever holds a column's whole domain; the listing is bounded
    while the counts stay exact.
    """
    entries = []
    for r in rules:
        c = f"`{r.column}`"
        numeric = isinstance(df.schema[r.column].dataType, T.NumericType)
        allowed = ", ".join(E.sql_str(str(v)) for v in r.values)
        member = f"cast({c} as string) in ({allowed})" if allowed else "false"
        entries.append(f"named_struct('rid', {r.rule_id}, "
                       f"'num', {f'cast({c} as double)' if numeric else 'cast(null as double)'}, "
                       f"'v', cast({c} as string), 'bad', not coalesce({member}, false))")
    distinct = (df.select(F.expr(f"inline(array({', '.join(entries)}))")).where("v is not null")
                .groupBy("rid", "num", "v").agg(F.expr("max(bad) as bad")))
    kinds = distinct.selectExpr(
        "rid", "num", "v", "explode(if(bad, array('seen', 'bad'), array('seen'))) as kind")
    order = ["num", "v"]
    in_slice = Window.partitionBy("rid", "kind", "_s")
    # per hash slice: rank and size (the sizes add up to the exact count)
    sliced = (kinds.withColumn("_s", F.expr(f"pmod(xxhash64(v), {LIST_SLICES})"))
              .withColumn("_r", F.row_number().over(in_slice.orderBy(*order)))
              .withColumn("_sn", F.count(F.lit(1)).over(in_slice))
              .where(f"_r <= {LIST_VALUES}"))
    # at most LIST_SLICES · LIST_VALUES survivors per list
    ranked = sliced.withColumn("_r2", F.row_number().over(Window.partitionBy("rid", "kind").orderBy(*order)))
    j = ranked.groupBy("rid", "kind").agg(
        F.expr(f"sort_array(collect_list(if(_r2 <= {LIST_VALUES}, struct(num, v), null))) as vals"),
        F.expr("sum(if(_r = 1, _sn, 0)) as n"))
    aggs = []
    for r in rules:
        for kind in ("seen", "bad"):
            sel = f"rid = {r.rule_id} and kind = '{kind}'"
            aggs += [f"coalesce(first(case when {sel} then vals.v end, true), cast(array() as array<string>)) "
                     f"as {r._a(kind)}",
                     f"coalesce(first(case when {sel} then n end, true), cast(0 as bigint)) as {r._a(kind + '_n')}"]
    return j.agg(*[F.expr(a) for a in aggs])


def _pylist_sql(list_expr: str) -> str:
    return (f"('[' || array_to_string(list_transform({list_expr}, lambda x: '''' || x || ''''), ', ') || ']')")


def _fixed(x: Column, digits: int) -> Column:
    """Fixed-point text with ``digits`` decimals, rounding half-up (and
    printing -0.0 as 0.0). Both engines print the same text this way."""
    return F.format_string(f"%.{digits}f", F.round(x, digits) + F.lit(0.0))


def _fixed_sql(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', round({x}, {digits}) + 0.0)"


def _type_family(dt: T.DataType) -> str:
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return "int"
    if isinstance(dt, T.StringType):
        return "str"
    if isinstance(dt, T.BooleanType):
        return "bool"
    return dt.simpleString()


_TYPE_ALIASES = {"float": "float", "int": "int", "str": "str", "object": "str", "bool": "bool"}

_SQL_TYPE_FAMILY = ("case when typeof({c}) in ('DOUBLE','FLOAT') or typeof({c}) like 'DECIMAL%' then 'float' "
                    "when typeof({c}) in ('INTEGER','BIGINT','SMALLINT','TINYINT') then 'int' "
                    "when typeof({c}) = 'VARCHAR' then 'str' when typeof({c}) = 'BOOLEAN' then 'bool' "
                    "else lower(typeof({c})) end")


def _missing_row(rule_id: int, etype: str, column: str) -> Column:
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(etype).alias("expectation_type"),
                    F.lit(column).alias("column"), F.lit(False).alias("success"),
                    F.lit("COLUMN_NOT_FOUND").alias("observed_value"),
                    F.lit(f"Column '{column}' does not exist").alias("details"))


def _missing_sql(rule_id: int, etype: str, column: str) -> str:
    return (f"select {rule_id} as rule_id, '{etype}' as expectation_type, '{column}' as \"column\", "
            f"false as success, 'COLUMN_NOT_FOUND' as observed_value, "
            f"'Column ''{column}'' does not exist' as details")


def _row(rule_id, etype, column, success, observed, details) -> Column:
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(etype).alias("expectation_type"),
                    F.lit(column).cast("string").alias("column"), success.alias("success"),
                    observed.cast("string").alias("observed_value"), details.alias("details"))


def _sql_row(rule_id, etype, column, success, observed, details, src) -> str:
    col = "null" if column is None else f"'{column}'"
    return (f"select {rule_id} as rule_id, '{etype}' as expectation_type, cast({col} as varchar) as \"column\", "
            f"{success} as success, cast({observed} as varchar) as observed_value, {details} as details from {src}")


@dataclass
class Rule:
    column: str | None = None
    rule_id: int = field(default=0, init=False)
    etype = "expectation"

    def aggs(self, df: DataFrame) -> list[Column]:
        return []

    def distinct_aggs(self, df: DataFrame) -> list[Column]:
        """Exact distinct counts: each runs as its own aggregate (two-phase,
        keyed on the counted columns) instead of forcing an Expand of the
        whole rule pass."""
        return []

    def row(self, df: DataFrame) -> Column:
        raise NotImplementedError

    def sql_row(self, src: str, columns: set[str]) -> str:
        raise NotImplementedError

    def _a(self, name: str) -> str:
        return f"r{self.rule_id}_{name}"


@dataclass
class ColumnsMatch(Rule):
    expected: list = field(default_factory=lambda: list(S.CUSTOMER_COLUMNS))
    etype = "expect_table_columns_to_match_ordered_list"

    def _parts(self, columns):
        missing = sorted(set(self.expected) - set(columns))
        observed = "[" + ", ".join(f"'{c}'" for c in sorted(columns)) + "]"
        details = (f"Missing columns: {missing}" if missing else "All columns present")
        return not missing, observed, details

    def row(self, df):
        ok, observed, details = self._parts(df.columns)
        return _row(self.rule_id, self.etype, None, F.lit(ok), F.lit(observed), F.lit(details))

    def sql_row(self, src, columns):
        ok, observed, details = self._parts(columns)
        esc = observed.replace("'", "''")
        return _sql_row(self.rule_id, self.etype, None, str(ok).lower(), f"'{esc}'",
                        "'" + details.replace("'", "''") + "'", "(select 1)")


@dataclass
class RowCountBetween(Rule):
    min_value: int = S.MIN_ROWS
    max_value: int | None = None
    etype = "expect_table_row_count_to_be_between"

    def aggs(self, df):
        return [F.count(F.lit(1)).alias(self._a("n"))]

    def row(self, df):
        n = F.col(self._a("n"))
        ok = n >= self.min_value
        if self.max_value is not None:
            ok = ok & (n <= self.max_value)
        details = F.concat(F.lit("Row count "), n.cast("string"), F.lit(" "),
                           F.when(ok, "within").otherwise("outside"),
                           F.lit(f" [{_py(self.min_value)}, {_py(self.max_value)}]"))
        return _row(self.rule_id, self.etype, None, ok, n, details)

    def sql_row(self, src, columns):
        ok = f"count(*) >= {self.min_value}"
        if self.max_value is not None:
            ok += f" and count(*) <= {self.max_value}"
        details = (f"'Row count ' || count(*) || ' ' || case when {ok} then 'within' else 'outside' end"
                   f" || ' [{_py(self.min_value)}, {_py(self.max_value)}]'")
        return _sql_row(self.rule_id, self.etype, None, ok, "count(*)", details, src)


@dataclass
class ColumnExists(Rule):
    etype = "expect_column_to_exist"

    def _parts(self, columns):
        ok = self.column in columns
        return ok, "exists" if ok else "missing", f"Column '{self.column}' {'found' if ok else 'NOT found'}"

    def row(self, df):
        ok, obs, det = self._parts(df.columns)
        return _row(self.rule_id, self.etype, self.column, F.lit(ok), F.lit(obs), F.lit(det))

    def sql_row(self, src, columns):
        ok, obs, det = self._parts(columns)
        return _sql_row(self.rule_id, self.etype, self.column, str(ok).lower(), f"'{obs}'",
                        "'" + det.replace("'", "''") + "'", "(select 1)")


@dataclass
class NotNull(Rule):
    etype = "expect_column_values_to_not_be_null"

    def aggs(self, df):
        if self.column not in df.columns:
            return []
        c = F.col(self.column)
        cond = c.isNull()
        if isinstance(df.schema[self.column].dataType, (T.DoubleType, T.FloatType)):
            cond = cond | F.isnan(c)
        return [F.count_if(cond).alias(self._a("nulls"))]

    def row(self, df):
        if self.column not in df.columns:
            return _missing_row(self.rule_id, self.etype, self.column)
        n = F.col(self._a("nulls"))
        return _row(self.rule_id, self.etype, self.column, n == 0,
                    F.concat(n.cast("string"), F.lit(" nulls")),
                    F.concat(n.cast("string"), F.lit(" null values found")))

    def sql_row(self, src, columns):
        if self.column not in columns:
            return _missing_sql(self.rule_id, self.etype, self.column)
        c = self.column
        n = f"count_if({c} is null or (typeof({c}) in ('DOUBLE','FLOAT') and isnan(try_cast({c} as double))))"
        return _sql_row(self.rule_id, self.etype, c, f"{n} = 0", f"{n} || ' nulls'",
                        f"{n} || ' null values found'", src)


@dataclass
class OfType(Rule):
    type_name: str = "float"
    etype = "expect_column_values_to_be_of_type"

    def row(self, df):
        if self.column not in df.columns:
            return _missing_row(self.rule_id, self.etype, self.column)
        actual = _type_family(df.schema[self.column].dataType)
        ok = _TYPE_ALIASES.get(self.type_name, self.type_name) == actual
        return _row(self.rule_id, self.etype, self.column, F.lit(ok), F.lit(actual),
                    F.lit(f"Expected type '{self.type_name}', got '{actual}'"))

    def sql_row(self, src, columns):
        if self.column not in columns:
            return _missing_sql(self.rule_id, self.etype, self.column)
        fam = _SQL_TYPE_FAMILY.format(c=f"any_value({self.column})")
        want = _TYPE_ALIASES.get(self.type_name, self.type_name)
        return _sql_row(self.rule_id, self.etype, self.column, f"{fam} = '{want}'", fam,
                        f"'Expected type ''{self.type_name}'', got ''' || {fam} || ''''", src)


@dataclass
class CastableTo(Rule):
    """Text values that do not convert to the type (nulls ignored). A
    declared schema makes :class:`OfType` trivially true for typed columns;
    this checks the raw text instead."""
    type_name: str = "float"
    etype = "expect_column_values_to_be_castable"

    def _pattern(self) -> str:
        if self.type_name == "int":
            return r"^\s*[+-]?\d+\s*$"
        return E.NUMERIC_TEXT_PATTERN

    def aggs(self, df):
        if self.column not in df.columns:
            return []
        c = F.col(self.column).cast("string")
        return [F.count_if(c.isNotNull() & ~c.rlike(self._pattern())).alias(self._a("bad"))]

    def row(self, df):
        if self.column not in df.columns:
            return _missing_row(self.rule_id, self.etype, self.column)
        b = F.col(self._a("bad"))
        return _row(self.rule_id, self.etype, self.column, b == 0,
                    F.concat(b.cast("string"), F.lit(" values not castable")),
                    F.lit(f"Expected text convertible to '{self.type_name}'"))

    def sql_row(self, src, columns):
        if self.column not in columns:
            return _missing_sql(self.rule_id, self.etype, self.column)
        c = self.column
        b = f"count_if({c} is not null and not regexp_matches(cast({c} as varchar), '{self._pattern()}'))"
        details = "'Expected text convertible to ''" + self.type_name + "'''"
        return _sql_row(self.rule_id, self.etype, c, f"{b} = 0", f"{b} || ' values not castable'", details, src)


@dataclass
class Between(Rule):
    min_value: float | None = None
    max_value: float | None = None
    etype = "expect_column_values_to_be_between"

    def _x(self, df):
        dt = df.schema[self.column].dataType
        c = F.col(self.column)
        return E.to_number(c) if isinstance(dt, T.StringType) else E.nan_to_null(c.cast("double"))

    def aggs(self, df):
        if self.column not in df.columns:
            return []
        x = self._x(df)
        out = [F.min(x).alias(self._a("lo")), F.max(x).alias(self._a("hi"))]
        out.append(F.count_if(x < self.min_value).alias(self._a("below")) if self.min_value is not None
                   else F.lit(0).cast("bigint").alias(self._a("below")))
        out.append(F.count_if(x > self.max_value).alias(self._a("above")) if self.max_value is not None
                   else F.lit(0).cast("bigint").alias(self._a("above")))
        return out

    def row(self, df):
        if self.column not in df.columns:
            return _missing_row(self.rule_id, self.etype, self.column)
        v = F.col(self._a("below")) + F.col(self._a("above"))
        ok = v == 0
        fmt = lambda c: F.coalesce(_fixed(F.col(c), 2), F.lit("nan"))
        observed = F.concat(F.lit("min="), fmt(self._a("lo")), F.lit(", max="), fmt(self._a("hi")))
        bounds = f"[{_py(self.min_value)}, {_py(self.max_value)}]"
        details = F.when(ok, F.lit(f"All values in {bounds}")).otherwise(
            F.concat(v.cast("string"), F.lit(f" values outside {bounds}")))
        return _row(self.rule_id, self.etype, self.column, ok, observed, details)

    def sql_row(self, src, columns):
        if self.column not in columns:
            return _missing_sql(self.rule_id, self.etype, self.column)
        x = f"x{self.rule_id}"
        below = f"count_if({x} < {self.min_value})" if self.min_value is not None else "0"
        above = f"count_if({x} > {self.max_value})" if self.max_value is not None else "0"
        v = f"({below} + {above})"
        bounds = f"[{_py(self.min_value)}, {_py(self.max_value)}]"
        obs = (f"'min=' || coalesce({_fixed_sql(f'min({x})', 2)}, 'nan') || ', max=' || "
               f"coalesce({_fixed_sql(f'max({x})', 2)}, 'nan')")
        det = f"case when {v} = 0 then 'All values in {bounds}' else {v} || ' values outside {bounds}' end"
        c = self.column
        num = (f"case when typeof({c}) = 'VARCHAR' then (case when regexp_matches(cast({c} as varchar), "
               f"'{E.NUMERIC_TEXT_PATTERN}') then try_cast(trim(cast({c} as varchar), (' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) as double) end) "
               f"else case when isnan(try_cast({c} as double)) then null else try_cast({c} as double) end end")
        inner = f"(select {num} as {x} from {src})"
        return _sql_row(self.rule_id, self.etype, c, f"{v} = 0", obs, det, inner)


@dataclass
class InSet(Rule):
    values: list = field(default_factory=list)
    etype = "expect_column_values_to_be_in_set"

    # The value lists come from ``_value_lists`` (a distributed pass shared by
    # every in-set rule of a suite), not from this rule's aggregates.

    def row(self, df):
        if self.column not in df.columns:
            return _missing_row(self.rule_id, self.etype, self.column)
        ok = F.expr(f"{self._a('bad_n')} = 0")
        details = F.when(ok, F.lit("All values in expected set")).otherwise(
            F.concat(F.lit("Unexpected values: "), _listing(self._a("bad"), self._a("bad_n"))))
        return _row(self.rule_id, self.etype, self.column, ok,
                    _listing(self._a("seen"), self._a("seen_n")), details)

    def sql_row(self, src, columns):
        if self.column not in columns:
            return _missing_sql(self.rule_id, self.etype, self.column)
        c = self.column
        allowed = ", ".join("'" + v.replace("'", "''") + "'" for v in self.values)
        seen = f"list_sort(list_distinct(coalesce(list({c}) filter (where {c} is not null), [])))"
        bad = f"list_sort(list_distinct(coalesce(list({c}) filter (where {c} is not null and {c} not in ({allowed})), [])))"
        det = f"case when len({bad}) = 0 then 'All values in expected set' else 'Unexpected values: ' || {_pylist_sql(bad)} end"
        return _sql_row(self.rule_id, self.etype, c, f"len({bad}) = 0", _pylist_sql(seen), det, src)


@dataclass
class UniqueCountBetween(Rule):
    """Distinct non-null values between bounds; ``min_value='rows'`` means
    every row must carry a distinct value (real uniqueness)."""
    min_value: int | str = "rows"
    max_value: int | str | None = "rows"
    etype = "expect_column_unique_value_count_to_be_between"

    def aggs(self, df):
        if self.column not in df.columns:
            return []
        return [F.count(F.lit(1)).alias(self._a("rows"))]

    def distinct_aggs(self, df):
        if self.column not in df.columns:
            return []
        return [F.count_distinct(F.col(self.column)).alias(self._a("nd"))]

    def _bound(self, v, rows):
        return rows if v == "rows" else F.lit(v)

    def row(self, df):
        if self.column not in df.columns:
            return _missing_row(self.rule_id, self.etype, self.column)
        nd, rows = F.col(self._a("nd")), F.col(self._a("rows"))
        ok = nd >= self._bound(self.min_value, rows)
        if self.max_value is not None:
            ok = ok & (nd <= self._bound(self.max_value, rows))
        return _row(self.rule_id, self.etype, self.column, ok, nd,
                    F.concat(nd.cast("string"), F.lit(" unique values")))

    def sql_row(self, src, columns):
        if self.column not in columns:
            return _missing_sql(self.rule_id, self.etype, self.column)
        nd = f"count(distinct {self.column})"
        b = lambda v: "count(*)" if v == "rows" else str(v)
        ok = f"{nd} >= {b(self.min_value)}"
        if self.max_value is not None:
            ok += f" and {nd} <= {b(self.max_value)}"
        return _sql_row(self.rule_id, self.etype, self.column, ok, nd, f"{nd} || ' unique values'", src)


@dataclass
class MeanBetween(Rule):
    min_value: float = 0.0
    max_value: float = 0.0
    etype = "expect_column_mean_to_be_between"

    def aggs(self, df):
        if self.column not in df.columns:
            return []
        dt = df.schema[self.column].dataType
        c = F.col(self.column)
        x = E.to_number(c) if isinstance(dt, T.StringType) else E.nan_to_null(c.cast("double"))
        return [F.avg(x).alias(self._a("mean"))]

    def row(self, df):
        if self.column not in df.columns:
            return _missing_row(self.rule_id, self.etype, self.column)
        m = F.col(self._a("mean"))
        ok = F.coalesce((m >= self.min_value) & (m <= self.max_value), F.lit(False))
        txt = F.coalesce(_fixed(m, 4), F.lit("nan"))
        details = F.concat(F.lit("Mean "), txt, F.lit(" "), F.when(ok, "within").otherwise("outside"),
                           F.lit(f" [{_py(self.min_value)}, {_py(self.max_value)}]"))
        return _row(self.rule_id, self.etype, self.column, ok, txt, details)

    def sql_row(self, src, columns):
        if self.column not in columns:
            return _missing_sql(self.rule_id, self.etype, self.column)
        m = f"avg(case when isnan(try_cast({self.column} as double)) then null else try_cast({self.column} as double) end)"
        ok = f"coalesce({m} >= {self.min_value} and {m} <= {self.max_value}, false)"
        txt = f"coalesce({_fixed_sql(m, 4)}, 'nan')"
        det = (f"'Mean ' || {txt} || ' ' || case when {ok} then 'within' else 'outside' end || "
               f"' [{_py(self.min_value)}, {_py(self.max_value)}]'")
        return _sql_row(self.rule_id, self.etype, self.column, ok, txt, det, src)


@dataclass
class Unique(Rule):
    """Rows minus distinct key tuples must be zero (composite keys allowed)."""
    columns: list = field(default_factory=list)
    etype = "expect_compound_columns_to_be_unique"

    def _cols(self):
        return self.columns or [self.column]

    def aggs(self, df):
        return [F.count(F.lit(1)).alias(self._a("rows"))]

    def distinct_aggs(self, df):
        return [F.count_distinct(*[F.col(c) for c in self._cols()]).alias(self._a("nd"))]

    def row(self, df):
        d = F.col(self._a("rows")) - F.col(self._a("nd"))
        name = ",".join(self._cols())
        return _row(self.rule_id, self.etype, name, d == 0,
                    F.concat(d.cast("string"), F.lit(" duplicate rows")),
                    F.concat(d.cast("string"), F.lit(" rows repeat an earlier key")))

    def sql_row(self, src, columns):
        cols = self._cols()
        d = f"(count(*) - count(distinct ({', '.join(cols)})))" if len(cols) > 1 else f"(count(*) - count(distinct {cols[0]}))"
        nn = " and ".join(f"{c} is not null" for c in cols)
        d = f"(count(*) - count(distinct case when {nn} then ({', '.join(cols)}) end))" if len(cols) > 1 else d
        return _sql_row(self.rule_id, self.etype, ",".join(cols), f"{d} = 0", f"{d} || ' duplicate rows'",
                        f"{d} || ' rows repeat an earlier key'", src)


@dataclass
class Predicate(Rule):
    """Custom rule: every row satisfies a SQL predicate (nulls fail)."""
    expr: str = "true"
    name: str = "custom"
    etype = "expect_rows_to_satisfy"

    def aggs(self, df):
        return [F.count_if(~F.coalesce(F.expr(self.expr), F.lit(False))).alias(self._a("bad"))]

    def row(self, df):
        b = F.col(self._a("bad"))
        return _row(self.rule_id, self.etype, self.name, b == 0,
                    F.concat(b.cast("string"), F.lit(" failing rows")), F.lit(self.expr))

    def sql_row(self, src, columns):
        b = f"count_if(not coalesce({self.expr}, false))"
        return _sql_row(self.rule_id, self.etype, self.name, f"{b} = 0", f"{b} || ' failing rows'",
                        "'" + self.expr.replace("'", "''") + "'", src)


def customer_suite(min_rows: int = S.MIN_ROWS) -> list[Rule]:
    """The 47-rule customer suite: columns, rows, existence, nulls, types,
    ranges, means, allowed sets, and id uniqueness."""
    rules: list[Rule] = [ColumnsMatch(), RowCountBetween(min_value=min_rows)]
    rules += [ColumnExists(c) for c in S.CRITICAL_COLUMNS]
    rules += [NotNull(c) for c in S.CRITICAL_COLUMNS]
    rules += [OfType(c, type_name=t) for c, t in S.TYPE_RULES]
    rules += [Between(c, min_value=lo, max_value=hi) for c, lo, hi in S.RANGE_RULES]
    rules += [MeanBetween(c, min_value=lo, max_value=hi) for c, lo, hi in S.MEAN_RULES]
    rules += [InSet(c, values=v) for c, v in S.IN_SET_RULES]
    rules += [UniqueCountBetween(S.ID_COL)]
    return rules


def _numbered(rules: list[Rule]) -> list[Rule]:
    for i, r in enumerate(rules, start=1):
        r.rule_id = i
    return rules


def run_suite(df: DataFrame, rules: list[Rule], separate_distinct: bool = True) -> DataFrame:
    """Evaluate every rule in one aggregate pass; one report row per rule.

    Exact distinct counts mixed into that pass make Spark expand every row
    once per distinct group. With ``separate_distinct`` (the default, right
    for scans) each distinct count is its own two-phase aggregate instead;
    for an expensive derived input pass ``False`` so the input is computed
    only once."""
    rules = _numbered(rules)
    listed = [r for r in rules if isinstance(r, InSet) and r.column in df.columns]
    if listed and not separate_distinct:
        # the value lists are a second pass: materialise the expensive input
        # once (recomputing it per pass would repeat all its shuffles), after
        # which separate distinct aggregates are cheap too
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
        separate_distinct = True
    aggs = [a for r in rules for a in r.aggs(df)]
    distinct = [d for r in rules for d in r.distinct_aggs(df)]
    if not separate_distinct:
        aggs, distinct = aggs + distinct, []
    parts = [df.agg(*aggs) if aggs else df.sparkSession.range(1).select(F.lit(1).alias("_one"))]
    parts += [df.agg(d) for d in distinct]
    if listed:
        parts.append(_value_lists(df, listed))
    base = parts[0]
    if len(parts) > 1:
        # one-row results side by side: union (missing columns null) and fold
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p, allowMissingColumns=True)
        base = u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in u.columns])
    return base.select(F.inline(F.array(*[r.row(df) for r in rules])))


def suite_values(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, column, kind, value, n): every non-null value that a suite's in-set
    rules saw, ``expected`` or ``unexpected``, with its rows - the whole of what the
    report prints the first values of. One unpivot and one aggregate for all rules."""
    listed = [r for r in _numbered(rules) if isinstance(r, InSet) and r.column in df.columns]
    if not listed:
        return df.sparkSession.createDataFrame([], "rule_id int, column string, kind string, value string, n long")
    cells = F.array(*[
        F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.column).alias("column"),
                 F.when(E.is_in(F.col(r.column).cast("string"), [str(v) for v in r.values]), "expected")
                 .otherwise("unexpected").alias("kind"),
                 F.col(r.column).cast("string").alias("value"))
        for r in listed])
    return (df.select(F.inline(cells)).where("value is not null")
            .groupBy("rule_id", "column", "kind", "value").agg(F.count(F.lit(1)).alias("n")))


def summarize(report: DataFrame) -> DataFrame:
    """total, passed, failed, success_rate (4 digits; 0 for an empty suite)."""
    total = F.count(F.lit(1))
    passed = F.count_if(F.col("success"))
    return report.agg(
        total.alias("total"), passed.alias("passed"),
        F.count_if(~F.col("success")).alias("failed"),
        F.when(total > 0, F.round(passed / total, 4)).otherwise(F.lit(0.0)).alias("success_rate"))


def suite_sql(src: str, columns: list[str], rules: list[Rule]) -> str:
    rules = _numbered(rules)
    return "\nunion all\n".join(r.sql_row(src, set(columns)) for r in rules)


class ValidationFailed(Exception):
    pass


def gate(report: DataFrame, fail_on_error: bool = True) -> int:
    """Driver action after the report is written: count failed rules and
    raise when asked to. Reads one number, never the data."""
    failed = report.where(~F.col("success")).count()
    if failed and fail_on_error:
        raise ValidationFailed(f"{failed} rules of the suite are broken")
    return failed

"""Every private-analytics query by name, over whole tables, each with a DuckDB oracle where SQL can state it.

Doubles are rounded to six digits on both sides: the engines' logarithms differ in the last bit.
Noise is the seeded test noise, which the oracle can follow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.rand import Noise, laplace_bits, normal_table
from ..operators import cluster, encode, marginals, prep, privacy, prompt, sampling, score, synth
from ..sources.schema import DECLARED, PublicSchema
from ..sources.tables import read_parquet
from . import experiment

SEED = 7
INF = float("inf")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(exprs.col(c), digits) + 0.0).alias(c) if t == "double" else exprs.col(c) for c, t in df.dtypes])


def declared(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prep.prepare(read_parquet(spark, sf_dir, name), DECLARED[name], numeric=name == "labels")


# -- SQL fragments -------------------------------------------------------------------------------


def _r(x: str, digits: int = 6) -> str:
    return f"(round(({x})::DOUBLE, {digits}) + 0.0::DOUBLE)"


def _u(seed, *parts: str) -> str:
    joined = ", ".join([f"'{seed}'", *[f"({p})::VARCHAR" for p in parts]])
    return f"((('0x' || substr(md5(concat_ws('|', {joined})), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def _lap(scale: float, seed, *parts: str) -> str:
    u = f"({_u(seed, *parts)} - 0.5::DOUBLE)"
    return f"(-{scale!r}::DOUBLE * sign({u}) * ln(1.0::DOUBLE - 2.0::DOUBLE * abs({u})))"


def _i60(seed, *parts: str) -> str:
    """A keyed integer below 2**60."""
    joined = ", ".join([f"'{seed}'", *[f"({p})::VARCHAR" for p in parts]])
    return f"('0x' || substr(md5(concat_ws('|', {joined})), 1, 15))::BIGINT"


def _geo(epsilon: float, seed, *parts: str) -> str:
    """Discrete Laplace noise: the difference of two geometric numbers, bit by bit."""
    side = lambda s: " + ".join(f"({_i60(seed, *parts, repr_(s), repr_(str(j)))} < {t})::BIGINT * {1 << j}" for j, t in enumerate(laplace_bits(epsilon)))
    return f"(({side('+')}) - ({side('-')}))"


def _dnorm(sigma: float, seed, *parts: str) -> str:
    """Discrete normal noise: how many thresholds the keyed integer reaches."""
    table = normal_table(sigma)
    return f"(len(list_filter([{', '.join(map(str, table))}]::BIGINT[], lambda t: t <= {_i60(seed, *parts, repr_('0'))})) - {len(table) // 2})"


def _h(seed, *parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join([f"'{seed}'", *[f"({p})::VARCHAR" for p in parts]]) + "))"


ORDERS = """o AS (SELECT o_orderkey AS row_id, least(greatest(o_totalprice, 0.0::DOUBLE), 500000.0::DOUBLE) / 500000.0::DOUBLE AS o_totalprice, o_orderstatus,
  (upper(trim(o_orderpriority)) = '1-URGENT')::INT AS target FROM orders
  WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL AND o_orderstatus <> '?' AND o_orderpriority <> '?')"""


def _scaled(c: str, low: float, high: float) -> str:
    return f"((least(greatest({c}, {low!r}::DOUBLE), {high!r}::DOUBLE) - {low!r}::DOUBLE) / ({high!r}::DOUBLE - {low!r}::DOUBLE))"


LINES = (
    "l AS (SELECT " + ", ".join(f"{_scaled(c, *b)} AS {c}" for c, b in DECLARED["lineitem"].bounds.items())
    + ", l_linestatus, (upper(trim(l_returnflag)) = 'R')::INT AS target FROM lineitem WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in (*DECLARED["lineitem"].bounds, "l_linestatus", "l_returnflag")) + ")"
)


def _bin(x: str, n: int) -> str:
    inner = exprs.edges(n)[1:-1]
    return "(" + " + ".join(f"({x} >= {e!r}::DOUBLE)::INT" for e in inner) + ")"


CODED_LINES = LINES + ", c AS (SELECT " + ", ".join(f"{_bin(c, 8)} AS {c}" for c in DECLARED["lineitem"].bounds) + ", CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS l_linestatus, target FROM l)"
CODED_ORDERS = ORDERS + f", c AS (SELECT row_id, {_bin('o_totalprice', 8)} AS o_totalprice, greatest(coalesce(list_position(['F','O','P'], o_orderstatus), 0) - 1, 0) AS o_orderstatus, target FROM o)"
LINE_ATTRS = [*DECLARED["lineitem"].features, "target"]
LINE_SIZES = marginals.sizes(DECLARED["lineitem"])


# -- sources, projection, scalar expressions --------------------------------------------------------


@query("SELECT c_custkey, c_mktsegment FROM customer")
def scan_project(spark, d):
    return read_parquet(spark, d, "customer").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey IS NOT NULL AND c_name <> '?' AND c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL AND c_mktsegment <> '?'")
def clean_drop_nulls(spark, d):
    return prep.clean(read_parquet(spark, d, "customer"))


@query("SELECT o_orderkey, (upper(trim(o_orderpriority)) = '1-URGENT')::INT AS target FROM orders")
def binarize_label_string(spark, d):
    return read_parquet(spark, d, "orders").select("o_orderkey", prep.binarize(F.col("o_orderpriority"), "1-URGENT", False).alias("target"))


@query("SELECT doc_id, (quality = 1)::INT AS target FROM labels")
def binarize_label_numeric(spark, d):
    df = read_parquet(spark, d, "labels")
    return df.select("doc_id", prep.binarize(F.col("quality"), "1", prep.numeric_labels(df, "quality", "1")).alias("target"))


@query("SELECT column_name AS name, (column_type NOT IN ('VARCHAR', 'DATE', 'BOOLEAN') AND column_type NOT LIKE 'TIMESTAMP%')::INT AS is_numeric FROM (DESCRIBE orders) WHERE column_name <> 'o_orderpriority'")
def type_split(spark, d):
    """Columns by physical type, without the label: what a table without a schema file starts from."""
    numeric, other = prep.split_types(read_parquet(spark, d, "orders"), "o_orderpriority")
    return spark.createDataFrame([(c, int(c in numeric)) for c in [*numeric, *other]], "name string, is_numeric int")


@query(f"WITH {ORDERS} SELECT row_id, {_r('o_totalprice', 9)} AS o_totalprice, o_orderstatus, target FROM o")
def prepare_table(spark, d):
    return r6(declared(spark, d, "orders"), 9)  # no decimal ties at nine digits


@query(f"SELECT o_orderkey, {_r(_scaled('o_totalprice', 0.0, 500000.0), 9)} AS scaled FROM orders")
def clip_scale(spark, d):
    return r6(read_parquet(spark, d, "orders").select("o_orderkey", exprs.scale(DECLARED["orders"], "o_totalprice").alias("scaled")), 9)


@query(f"WITH {ORDERS} SELECT row_id, {_r('round(o_totalprice * 500000.0::DOUBLE, 4)')} AS original FROM o")
def unscale(spark, d):
    return r6(declared(spark, d, "orders").select("row_id", exprs.unscale(DECLARED["orders"], "o_totalprice", 4).alias("original")))


@query("SELECT c_custkey, " + _r("least(greatest(coalesce(try_cast(c_name AS DOUBLE), 0), 0), 1)") + " AS from_text, " + _r("least(greatest(c_acctbal, 0), 1)") + " AS clipped FROM customer")
def clip_numeric(spark, d):
    df = read_parquet(spark, d, "customer")
    return r6(df.select("c_custkey", exprs.clip_numeric(F.col("c_name")).alias("from_text"), exprs.clip_numeric(F.col("c_acctbal")).alias("clipped")))


@query(f"WITH {ORDERS} SELECT row_id, {_bin('o_totalprice', 8)} AS code FROM o")
def digitize8(spark, d):
    return exprs.digitize(declared(spark, d, "orders"), ["o_totalprice"], 8).select("row_id", F.col("o_totalprice_bin").alias("code"))


@query(f"WITH {ORDERS} SELECT row_id, {_bin('o_totalprice', 10)} AS code FROM o")
def digitize10(spark, d):
    return exprs.digitize(declared(spark, d, "orders"), ["o_totalprice"], 10).select("row_id", F.col("o_totalprice_bin").alias("code"))


@query(f"WITH {ORDERS} SELECT row_id, {_r(_bin('o_totalprice', 8) + ' * 0.125::DOUBLE + 0.0625::DOUBLE')} AS middle FROM o")
def bin_midpoint(spark, d):
    binned = exprs.digitize(declared(spark, d, "orders"), ["o_totalprice"], 8)
    return r6(binned.select("row_id", exprs.midpoint(F.col("o_totalprice_bin"), 8).alias("middle")))


@query("SELECT o_orderkey, list_position(['F','O','P'], o_orderstatus) - 1 AS code FROM orders")
def cat_codes_strict(spark, d):
    return read_parquet(spark, d, "orders").select("o_orderkey", exprs.code(F.col("o_orderstatus"), ("F", "O", "P"), strict=True).alias("code"))


@query("SELECT l_returnflag, greatest(coalesce(list_position(['N','R'], l_returnflag), 0) - 1, 0) AS code, count(*) AS n FROM lineitem GROUP BY ALL")
def cat_codes_lenient(spark, d):
    df = read_parquet(spark, d, "lineitem").select("l_returnflag", exprs.code(F.col("l_returnflag"), ("N", "R")).alias("code"))
    return df.groupBy("l_returnflag", "code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, ['F','O','P'][least(greatest(o_orderkey % 7 - 2, 0), 2) + 1] AS value FROM orders")
def code_decode(spark, d):
    return read_parquet(spark, d, "orders").select("o_orderkey", exprs.decode(F.col("o_orderkey") % 7 - 2, ("F", "O", "P")).alias("value"))


@query("SELECT event_id, least(greatest(coalesce(round(value / 100.0::DOUBLE), 0), 0), 1)::INT AS target FROM events")
def target_codes(spark, d):
    return read_parquet(spark, d, "events").select("event_id", exprs.target_code(F.col("value") / 100.0).alias("target"))


PART_P = f"""p AS (SELECT p_partkey AS row_id, {_scaled('p_size', 1.0, 50.0)} AS p_size, {_scaled('p_retailprice', 900.0, 1000.0)} AS p_retailprice, p_brand, (upper(trim(p_type)) = 'PROMO')::INT AS target
  FROM part WHERE p_partkey IS NOT NULL AND p_size IS NOT NULL AND p_retailprice IS NOT NULL AND p_brand <> '?' AND p_type <> '?')"""
_BRANDS = "[" + ", ".join(f"'Brand#{i}'" for i in range(1, 26)) + "]"


@query(f"WITH {PART_P} SELECT 'p_size' AS attr, max({_bin('p_size', 8)}) + 1 AS size FROM p UNION ALL SELECT 'p_brand', max(greatest(coalesce(list_position({_BRANDS}, p_brand), 0) - 1, 0)) + 1 FROM p UNION ALL SELECT 'target', 2")
def observed_domain(spark, d):
    coded = marginals.encode_rows(declared(spark, d, "part"), DECLARED["part"])
    seen = marginals.observed_sizes(coded, ["p_size", "p_brand"])
    return seen.unionByName(spark.createDataFrame([("target", 2)], "attr string, size long"))


@query(f"""WITH {PART_P} SELECT row_id, CASE WHEN p_size <= 0.5 THEN 'low' ELSE 'high' END AS size_group,
  CASE WHEN list_position({_BRANDS}, p_brand) <= 13 THEN 'group0' ELSE 'group1' END AS brand_group, target::VARCHAR AS target_group FROM p""")
def public_group_key(spark, d):
    s = DECLARED["part"]
    return declared(spark, d, "part").select("row_id", exprs.group_key(s, "p_size").alias("size_group"), exprs.group_key(s, "p_brand").alias("brand_group"), exprs.group_key(s, "target").alias("target_group"))


@query(
    f"""WITH {ORDERS}, k AS (SELECT target::VARCHAR AS g0, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'group0' ELSE 'group1' END AS g1, CASE WHEN o_totalprice <= 0.5 THEN 'low' ELSE 'high' END AS g2, count(*) AS n FROM o GROUP BY ALL)
  SELECT g0, g1, g2, coalesce(n, 0) AS n FROM (SELECT unnest(['0','1']) AS g0) CROSS JOIN (SELECT unnest(['group0','group1']) AS g1) CROSS JOIN (SELECT unnest(['low','high']) AS g2) LEFT JOIN k USING (g0, g1, g2)"""
)
def key_product(spark, d):
    """Every public key, whether it has rows or not."""
    s = DECLARED["orders"]
    spec = exprs.group_spec(s, 8)
    names = [f"g{i}" for i in range(len(spec))]
    found = declared(spark, d, "orders").groupBy(*[exprs.group_key(s, c).alias(n) for n, c in zip(names, spec)]).agg(F.count(F.lit(1)).alias("n"))
    return privacy.key_grid(s, spec, spark).join(found, names, "left").select(*names, F.coalesce("n", F.lit(0)).alias("n"))


_BANK = PublicSchema("Bank", {}, {"marital": ("married", "single", "divorced"), "contact": ("cellular", "telephone")}, "y", "yes")
_DIABETES = PublicSchema("Diabetes", {"Age": (20.0, 90.0), "Pregnancies": (0.0, 20.0)}, {}, "y", "1")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Married' ELSE 'Not-Married' END AS marital, CASE WHEN c_nationkey % 2 = 0 THEN 'Cellular' ELSE 'Non-Cellular' END AS contact FROM customer")
def category_merge(spark, d):
    df = read_parquet(spark, d, "customer")
    marital = F.when(F.col("c_mktsegment") == "BUILDING", " Married ").otherwise("single")
    contact = F.when(F.col("c_nationkey") % 2 == 0, "CELLULAR").otherwise("telephone")
    named = df.select("c_custkey", marital.alias("marital"), contact.alias("contact"))
    return named.select("c_custkey", *[exprs.group_key(_BANK, c).alias(c) for c in ("marital", "contact")])


@query("SELECT c_custkey, CASE WHEN 20 + c_custkey % 71 <= 33 THEN 'low' ELSE 'high' END AS age_group, CASE WHEN c_custkey % 21 <= 4 THEN 'low' ELSE 'high' END AS pregnancies_group FROM customer")
def scaled_thresholds(spark, d):
    raw = read_parquet(spark, d, "customer").select("c_custkey", (20 + F.col("c_custkey") % 71).cast("double").alias("Age"), (F.col("c_custkey") % 21).cast("double").alias("Pregnancies"))
    scaled = raw.select("c_custkey", *[exprs.scale(_DIABETES, c).alias(c) for c in _DIABETES.numeric])
    return scaled.select("c_custkey", exprs.group_key(_DIABETES, "Age").alias("age_group"), exprs.group_key(_DIABETES, "Pregnancies").alias("pregnancies_group"))


@query('SELECT c_custkey AS "customer key", c_mktsegment AS segment FROM customer')
def lower_names(spark, d):
    return prep.lower_names(read_parquet(spark, d, "customer").select(F.col("c_custkey").alias(" Customer Key"), F.col("c_mktsegment").alias("SEGMENT ")))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_values(spark, d):
    return read_parquet(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query(f"WITH {ORDERS} SELECT row_id, o_orderstatus FROM o WHERE target = 1")
def label_filter(spark, d):
    return declared(spark, d, "orders").filter("target = 1").select("row_id", "o_orderstatus")


# -- private aggregates ---------------------------------------------------------------------------


def _group_sql(eps: float, spec: list[str], empty: bool = False, rate: float = 1.0) -> str:
    """dp_group_by over orders in SQL; ``spec`` and ``rate`` as in the operator."""
    key_of = {"target": "target::VARCHAR", "o_orderstatus": "CASE WHEN o_orderstatus IN ('F', 'O') THEN 'group0' ELSE 'group1' END", "o_totalprice": "CASE WHEN o_totalprice <= 0.5 THEN 'low' ELSE 'high' END"}
    domain_of = {"target": "['0','1']", "o_orderstatus": "['group0','group1']", "o_totalprice": "['low','high']"}
    gs = [f"g{i}" for i in range(len(spec))] or ["g0"]
    keys = ", ".join(f"{key_of[c]} AS g{i}" for i, c in enumerate(spec)) or "'__ALL__' AS g0"
    grid = " CROSS JOIN ".join(f"(SELECT unnest({domain_of[c]}) AS g{i}, generate_subscripts({domain_of[c]}, 1) - 1 AS i{i})" for i, c in enumerate(spec)) or "(SELECT '__ALL__' AS g0, 0 AS i0)"
    weight, ident = 1, []
    for i in reversed(range(len(spec))):
        ident.append(f"i{i} * {weight}")
        weight *= 2
    ident = " + ".join(ident) or "0"
    each = eps / 3
    g = ", ".join(gs)
    key = f"concat_ws('/', {g})"
    if eps == INF:
        mean, noise = "CASE WHEN coalesce(n, 0) > 0 THEN least(greatest(s / n, 0), 1) ELSE 0.5 END", "0.0"
    else:
        mean = f"least(greatest((coalesce(s, 0) + {_lap(2.0 / each, SEED, repr_('mean'), key, repr_('o_totalprice'), repr_('sum'))}) / greatest(coalesce(n, 0) + {_lap(2.0 / each, SEED, repr_('mean'), key, repr_('o_totalprice'), repr_('count'))}, 1.0), 0), 1)"
        noise = _geo(each, SEED, repr_("mode"), key, "col", "v")
    where = " WHERE NOT (target = 1 AND o_orderstatus = 'P')" if empty else f" WHERE {_u(SEED, repr_('sample'), 'row_id')} < {rate!r}::DOUBLE" if rate < 1 else ""
    return f"""WITH {ORDERS}, k AS (SELECT *, {keys} FROM o{where}), grid AS (SELECT {g}, {ident} AS key_id FROM {grid}),
  st AS (SELECT {g}, count(*) AS n, sum(least(greatest(o_totalprice, 0), 1)) AS s FROM k GROUP BY ALL),
  dom AS (SELECT 'o_orderstatus' AS col, unnest(['F','O','P']) AS v, unnest([0,1,2]) AS pos UNION ALL SELECT 'target', unnest(['0','1']), unnest([0,1])),
  cnt AS (SELECT {g}, col, v, count(*) AS n FROM (SELECT {g}, 'o_orderstatus' AS col, o_orderstatus AS v FROM k UNION ALL SELECT {g}, 'target', target::VARCHAR FROM k) GROUP BY ALL),
  nz AS (SELECT {g}, key_id, col, v, pos, coalesce(n, 0) + {noise} AS z FROM grid CROSS JOIN dom LEFT JOIN cnt USING ({g}, col, v)),
  best AS (SELECT key_id, col, v FROM (SELECT *, row_number() OVER (PARTITION BY key_id, col ORDER BY z DESC, pos) AS r FROM nz) WHERE r = 1)
  SELECT key_id, {_r(mean)} AS o_totalprice, a.v AS o_orderstatus, b.v::INT AS target FROM grid LEFT JOIN st USING ({g})
  JOIN best a USING (key_id) JOIN best b USING (key_id) WHERE a.col = 'o_orderstatus' AND b.col = 'target'"""


def repr_(text: str) -> str:
    return "'" + text + "'"


def _grouped(spark, d, eps, shots, spec=None, keep=None):
    rows = declared(spark, d, "orders")
    if keep is not None:
        rows = rows.filter(keep)
    return r6(privacy.dp_group_by(rows, DECLARED["orders"], eps, shots, Noise.test(SEED), spec))


@query(_group_sql(INF, ["target"]))
def group_exact(spark, d):
    return _grouped(spark, d, INF, 2)


@query(_group_sql(1.0, []))
def dp_groupby_k1(spark, d):
    return _grouped(spark, d, 1.0, 1)


@query(_group_sql(1.0, ["target"]))
def dp_groupby_k2(spark, d):
    return _grouped(spark, d, 1.0, 2)


@query(_group_sql(2.0, ["target", "o_orderstatus"]))
def dp_groupby_k4(spark, d):
    return _grouped(spark, d, 2.0, 4)


@query(_group_sql(4.0, ["target", "o_orderstatus", "o_totalprice"]))
def dp_groupby_k8(spark, d):
    return _grouped(spark, d, 4.0, 8)


@query(_group_sql(INF, ["target", "o_orderstatus"], empty=True))
def dp_groupby_empty_group(spark, d):
    return _grouped(spark, d, INF, 4, keep="NOT (target = 1 AND o_orderstatus = 'P')")


@query(_group_sql(2.0, ["target", "o_orderstatus"], rate=0.5))
def dp_groupby_sampled(spark, d):
    """A Poisson sample of half of the rows; the ledger is charged what it costs the whole."""
    ledger = privacy.BudgetLedger(1.5)
    epsilon = ledger.spend("orders", 2.0, 0.5)
    return r6(privacy.dp_group_by(declared(spark, d, "orders"), DECLARED["orders"], epsilon, 4, Noise.test(SEED), ["target", "o_orderstatus"], sample_rate=0.5))


def _shots_sql(k: int, n: int) -> str:
    """The prototypes of four keys, resampled to k rows."""
    base = f"WITH p AS ({_group_sql(2.0, ['target', 'o_orderstatus'])}), r AS (SELECT *, row_number() OVER (ORDER BY {_h(SEED, repr_('resample'), 'key_id')}, key_id) AS r FROM p)"
    if k <= n:
        return base + f" SELECT * EXCLUDE (r), r::INT AS slot FROM r WHERE r <= {k}"
    return base + f" SELECT r.* EXCLUDE (r), s.slot::INT AS slot FROM (SELECT range AS slot, floor({_u(SEED, repr_('slot'), 'range')} * {n}) + 1 AS r FROM range(1, {k + 1})) s JOIN r USING (r)"


@query(_shots_sql(3, 4))
def dp_groupby_3_shots(spark, d):
    return r6(privacy.dp_group_by(declared(spark, d, "orders"), DECLARED["orders"], 2.0, 3, Noise.test(SEED), ["target", "o_orderstatus"], seed=SEED))


@query(f"SELECT o_orderstatus, (count(*) + {_geo(1.0, SEED, repr_('count'), 'o_orderstatus')})::BIGINT AS noisy FROM orders GROUP BY o_orderstatus")
def dp_count(spark, d):
    g = read_parquet(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return r6(g.select("o_orderstatus", privacy.noisy_count(F.col("n"), 1.0, Noise.test(SEED), "count", F.col("o_orderstatus")).alias("noisy")))


@query(
    f"WITH {LINES} SELECT l_linestatus, "
    + _r(f"least(greatest((sum(l_quantity) + {_lap(4.0, SEED, repr_('q'), 'l_linestatus', repr_('sum'))}) / greatest(count(*) + {_lap(4.0, SEED, repr_('q'), 'l_linestatus', repr_('count'))}, 1.0), 0), 1)")
    + " AS mean FROM l GROUP BY l_linestatus"
)
def dp_mean(spark, d):
    g = declared(spark, d, "lineitem").groupBy("l_linestatus").agg(F.sum("l_quantity").alias("s"), F.count(F.lit(1)).alias("n"))
    return r6(g.select("l_linestatus", privacy.noisy_mean(F.col("s"), F.col("n"), 0.5, Noise.test(SEED), "q", F.col("l_linestatus")).alias("mean")))


@query(
    f"""WITH {ORDERS}, z AS (SELECT target, v, pos, count(o.row_id) + {_geo(0.5, SEED, repr_('mode'), 'target', 'v')} AS z FROM (SELECT unnest([0,1]) AS target) CROSS JOIN (SELECT unnest(['F','O','P']) AS v, unnest([0,1,2]) AS pos)
  LEFT JOIN o USING (target) WHERE o.o_orderstatus = v OR o.row_id IS NULL GROUP BY target, v, pos)
  SELECT target, v AS mode FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY z DESC, pos) AS r FROM z) WHERE r = 1"""
)
def dp_mode(spark, d):
    g = declared(spark, d, "orders").groupBy("target", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    z = privacy.noisy_count(F.col("n"), 0.5, Noise.test(SEED), "mode", F.col("target"), F.col("o_orderstatus"))
    at = exprs.code(F.col("o_orderstatus"), ("F", "O", "P"))
    return g.groupBy("target").agg(F.max_by("o_orderstatus", F.struct(z.alias("z"), -at)).alias("mode"))


@query(f"SELECT o_orderkey, {_r(_lap(1.5, SEED, repr_('row'), 'o_orderkey'))} AS noise FROM orders")
def laplace_sample(spark, d):
    return r6(read_parquet(spark, d, "orders").select("o_orderkey", Noise.test(SEED).laplace(1.5, "row", F.col("o_orderkey")).alias("noise")))


# -- marginals ------------------------------------------------------------------------------------


@query(f"WITH {CODED_LINES} SELECT g.code::INT AS code, count(c.l_quantity) AS n FROM (SELECT unnest(range(8)) AS code) g LEFT JOIN c ON c.l_quantity = g.code GROUP BY 1")
def marginal_1way(spark, d):
    return marginals.one_way(marginals.encode_rows(declared(spark, d, "lineitem"), DECLARED["lineitem"]), "l_quantity", 8)


@query(f"""WITH {CODED_LINES} SELECT a::INT AS code_a, b::INT AS code_b, count(c.l_tax) AS n FROM (SELECT unnest(range(8)) AS a) CROSS JOIN (SELECT unnest(range(2)) AS b)
  LEFT JOIN c ON c.l_tax = a AND c.target = b GROUP BY ALL""")
def marginal_2way(spark, d):
    return marginals.two_way(marginals.encode_rows(declared(spark, d, "lineitem"), DECLARED["lineitem"]), "l_tax", "target", LINE_SIZES)


def _pairs_sql(pairs) -> str:
    return CODED_LINES + ", m AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS attr_a, '{b}' AS attr_b, x::INT AS code_a, y::INT AS code_b, coalesce(n, 0) AS n FROM (SELECT unnest(range({LINE_SIZES[a]})) AS x) CROSS JOIN (SELECT unnest(range({LINE_SIZES[b]})) AS y) "
        f"LEFT JOIN (SELECT {a} AS x, {b} AS y, count(*) AS n FROM c GROUP BY ALL) USING (x, y)"
        for a, b in pairs
    ) + ")"


ALL_PAIRS, STAR = marginals.all_pairs(LINE_ATTRS), marginals.target_star(LINE_ATTRS[:-1])
INDIF = """, t AS (SELECT *, greatest(sum(n) OVER (PARTITION BY attr_a, attr_b), 1)::DOUBLE AS total, (sum(n) OVER (PARTITION BY attr_a, attr_b, code_a))::DOUBLE AS na,
  (sum(n) OVER (PARTITION BY attr_a, attr_b, code_b))::DOUBLE AS nb FROM m)"""


def _line_pairs(spark, d, pairs):
    return marginals.pair_marginals(marginals.encode_rows(declared(spark, d, "lineitem"), DECLARED["lineitem"]), pairs, LINE_SIZES)


@query("WITH " + _pairs_sql(ALL_PAIRS) + " SELECT * FROM m")
def marginal_all_pairs(spark, d):
    return _line_pairs(spark, d, ALL_PAIRS)


@query("WITH " + _pairs_sql(ALL_PAIRS) + INDIF + " SELECT attr_a, attr_b, round(sum(abs(na * nb / total - n)), 4) AS indif FROM t GROUP BY ALL")
def indif_pairs(spark, d):
    return marginals.independence_difference(_line_pairs(spark, d, ALL_PAIRS)).withColumn("indif", F.round("indif", 4))


@query("WITH " + _pairs_sql(ALL_PAIRS) + INDIF + " SELECT attr_a, attr_b, round(sum(CASE WHEN attr_b = 'target' THEN abs(na * nb / total - n) ELSE 0.0::DOUBLE END), 4) AS indif FROM t GROUP BY attr_a, attr_b")
def indif_target_only(spark, d):
    coded = marginals.encode_rows(declared(spark, d, "lineitem"), DECLARED["lineitem"])
    return marginals.target_difference(coded, ALL_PAIRS, LINE_SIZES).withColumn("indif", F.round("indif", 4))


@query("WITH " + _pairs_sql(ALL_PAIRS) + f" SELECT attr_a, attr_b, code_a, code_b, {_r('n / greatest(sum(n) OVER (PARTITION BY attr_a, attr_b), 1)::DOUBLE')} AS answer FROM m")
def workload_answers(spark, d):
    return r6(marginals.workload_answers(_line_pairs(spark, d, ALL_PAIRS)))


@query("WITH " + _pairs_sql(STAR) + f" SELECT attr_a, attr_b, code_a, code_b, {_r('n / greatest(sum(n) OVER (PARTITION BY attr_a, attr_b), 1)::DOUBLE')} AS answer FROM m")
def workload_star(spark, d):
    return r6(marginals.workload_answers(_line_pairs(spark, d, STAR)))


TRIPLES = marginals.all_pairs(LINE_ATTRS, 3)


@query(
    "WITH " + CODED_LINES + ", m AS (" + " UNION ALL ".join(
        f"SELECT '{a},{b},{c}' AS attrs, x || ',' || y || ',' || z AS codes, coalesce(n, 0) AS n FROM (SELECT unnest(range({LINE_SIZES[a]})) AS x) CROSS JOIN (SELECT unnest(range({LINE_SIZES[b]})) AS y) CROSS JOIN (SELECT unnest(range({LINE_SIZES[c]})) AS z) "
        f"LEFT JOIN (SELECT {a} AS x, {b} AS y, {c} AS z, count(*) AS n FROM c GROUP BY ALL) USING (x, y, z)" for a, b, c in TRIPLES
    ) + f") SELECT attrs, codes, {_r('n / greatest(sum(n) OVER (PARTITION BY attrs), 1)::DOUBLE')} AS answer FROM m"
)
def workload_degree3(spark, d):
    """Tables of three attributes each, all from one pass."""
    coded = marginals.encode_rows(declared(spark, d, "lineitem"), DECLARED["lineitem"])
    tables = marginals.marginal_tables(coded, TRIPLES, LINE_SIZES).select(F.array_join("attrs", ",").alias("attrs"), F.array_join("codes", ",").alias("codes"), "n")
    return r6(marginals.workload_answers(tables, ["attrs"]))


# -- encoding, clustering, routing -------------------------------------------------------------------

SPEC = encode.onehot_spec(DECLARED["orders"], {"o_totalprice": 1.2, "o_orderstatus": 0.8})
_SN, _SC = SPEC.numeric[0][1], SPEC.blocks[0][2]
_X = [f"o_totalprice * {_SN!r}::DOUBLE", *[f"CASE WHEN o_orderstatus = '{v}' THEN {_SC!r}::DOUBLE ELSE 0.0::DOUBLE END" for v in "FOP"]]
CENTERS = [[0.2, 0.4, 0.1, 0.05], [0.5, 0.05, 0.45, 0.0], [0.8, 0.2, 0.2, 0.3]]


def _dist(c: list[float]) -> str:
    return "(" + " + ".join(f"({x} - {v!r}::DOUBLE) * ({x} - {v!r}::DOUBLE)" for x, v in zip(_X, c)) + ")"


def _nearest(ids=(0, 1, 2), centers=CENTERS) -> str:
    return "list_min([" + ", ".join(f"{{'d': {_dist(centers[i])}, 'id': {i}}}" for i in ids) + "]).id"


@query(f"WITH {ORDERS} SELECT row_id, {', '.join(f'{_r(x)} AS x{i}' for i, x in enumerate(_X))} FROM o")
def onehot_encode(spark, d):
    return r6(declared(spark, d, "orders").select("row_id", *[c.alias(f"x{i}") for i, c in enumerate(encode.coordinates(SPEC))]))


#: The exact centres of the rows of each cluster, read back as rows.
_DECODED = f"""WITH {ORDERS}, a AS (SELECT {_nearest()} AS cluster_id, {', '.join(f'avg({x}) AS x{j}' for j, x in enumerate(_X))} FROM o GROUP BY 1),
  dc AS (SELECT cluster_id, {_r(f'least(greatest(x0 / {_SN!r}::DOUBLE, 0), 1)')} AS o_totalprice, ['F','O','P'][list_position([x1, x2, x3], greatest(x1, x2, x3))] AS o_orderstatus FROM a)"""


def _decoded(spark, d) -> dict[int, dict]:
    """The exact centres of the rows of each cluster, decoded: k rows."""
    coded = declared(spark, d, "orders").select(encode.onehot(SPEC).alias("x"))
    return {r["cluster"]: encode.decode_center(SPEC, r["center"]) for r in cluster.step(coded, CENTERS, SPEC, INF, Noise.test(SEED), 0).collect()}


@query(f"{_DECODED} SELECT * FROM dc")
def center_decode(spark, d):
    return r6(spark.createDataFrame([(i, r["o_totalprice"], r["o_orderstatus"]) for i, r in _decoded(spark, d).items()], "cluster_id int, o_totalprice double, o_orderstatus string"))


@query(f"{_DECODED} SELECT range AS synth_id, o_totalprice, o_orderstatus, (range % 2)::INT AS target FROM dc, range(6) WHERE cluster_id = 1")
def centroid_fallback(spark, d):
    return r6(synth.centroid_fallback(spark, _decoded(spark, d)[1], DECLARED["orders"], 6))


@query(f"WITH {ORDERS} SELECT row_id, {_nearest()} AS cluster_id FROM o")
def kmeans_assign(spark, d):
    return cluster.assign(declared(spark, d, "orders"), SPEC, CENTERS).select("row_id", "cluster_id")


@query(f"WITH {ORDERS} SELECT {_nearest()} AS cluster_id, count(*) AS n FROM o GROUP BY 1")
def cluster_sizes(spark, d):
    return cluster.cluster_sizes(cluster.assign(declared(spark, d, "orders"), SPEC, CENTERS))


@query(f"WITH {ORDERS} SELECT row_id FROM o WHERE {_nearest()} = 1")
def cluster_filter(spark, d):
    return cluster.assign(declared(spark, d, "orders"), SPEC, CENTERS).filter("cluster_id = 1").select("row_id")


def _km_sql(eps: float) -> str:
    reach, upper = _SN + _SC, SPEC.upper
    n = f"greatest(count(*) + {_lap(2.0 / eps, SEED, repr_('km-count'), '0', 'cluster')}, 1.0)"
    cols = ", ".join(_r(f"least(greatest((sum(x{j}) + {_lap(2.0 * reach / eps, SEED, repr_('km-sum'), '0', 'cluster', str(j))}) / {n}, 0), {upper[j]!r})") + f" AS c{j}" for j in range(4))
    return f"WITH {ORDERS}, a AS (SELECT {_nearest()} AS cluster, {', '.join(f'{x} AS x{j}' for j, x in enumerate(_X))} FROM o) SELECT cluster, {_r(n)} AS n, {cols} FROM a GROUP BY cluster"


@query(_km_sql(1.0))
def kmeans_step(spark, d):
    coded = declared(spark, d, "orders").select(encode.onehot(SPEC).alias("x"))
    s = cluster.step(coded, CENTERS, SPEC, 1.0, Noise.test(SEED), 0)
    return r6(s.select("cluster", F.col("count").alias("n"), *[F.col("center")[j].alias(f"c{j}") for j in range(4)]))


def _km_rounds_sql(k: int, eps: float, rounds: int) -> str:
    """dp_kmeans, round by round: assignment by a join with the k centres, sums, noise, clipping."""
    reach, upper, each = _SN + _SC, SPEC.upper, eps / rounds
    start = cluster.initial_centers(SPEC, k, Noise.test(SEED))
    values = ", ".join("(" + ", ".join([str(i), *[f"{v!r}::DOUBLE" for v in c]]) + ")" for i, c in enumerate(start))
    sql = f"WITH {ORDERS}, x AS (SELECT row_id, {', '.join(f'{x} AS x{j}' for j, x in enumerate(_X))} FROM o), c0 AS (SELECT * FROM (VALUES {values}) t(cluster, {', '.join(f'c{j}' for j in range(4))}))"
    far = " + ".join(f"(x{j} - c{j}) * (x{j} - c{j})" for j in range(4))
    for r in range(rounds):
        n = f"greatest(coalesce(n, 0) + {_lap(2.0 / each, SEED, repr_('km-count'), repr_(str(r)), 'cluster')}, 1.0)"
        move = ", ".join(f"least(greatest((coalesce(s{j}, 0) + {_lap(2.0 * reach / each, SEED, repr_('km-sum'), repr_(str(r)), 'cluster', repr_(str(j)))}) / {n}, 0), {upper[j]!r}::DOUBLE) AS c{j}" for j in range(4))
        sql += f""", a{r} AS (SELECT row_id, min({{'d': {far}, 'id': cluster}}).id AS cluster FROM x CROSS JOIN c{r} GROUP BY row_id),
          s{r} AS (SELECT cluster, count(*) AS n, {', '.join(f'sum(x{j}) AS s{j}' for j in range(4))} FROM a{r} JOIN x USING (row_id) GROUP BY cluster),
          c{r + 1} AS (SELECT cluster, {move} FROM (SELECT cluster FROM c0) LEFT JOIN s{r} USING (cluster))"""
    return sql + f" SELECT cluster, {', '.join(_r(f'c{j}') + f' AS c{j}' for j in range(4))} FROM c{rounds}"


@query(_km_rounds_sql(3, 2.0, 3))
def dp_kmeans_fixed_rounds(spark, d):
    centers = cluster.dp_kmeans(declared(spark, d, "orders"), SPEC, 3, 2.0, Noise.test(SEED), rounds=3)
    return r6(spark.createDataFrame([(i, *c) for i, c in enumerate(centers)], "cluster int, c0 double, c1 double, c2 double, c3 double"))


@query(f"WITH {ORDERS} SELECT row_id, {_nearest()} AS cluster_id FROM o WHERE target = 1")
def route_nearest(spark, d):
    return cluster.assign(declared(spark, d, "orders").filter("target = 1"), SPEC, CENTERS).select("row_id", "cluster_id")


@query(f"WITH {ORDERS} SELECT row_id, {_nearest((0, 2))} AS cluster_id FROM o")
def route_nonempty(spark, d):
    pools = spark.createDataFrame([(0,), (2,)], "cluster_id int")
    return cluster.assign(declared(spark, d, "orders"), SPEC, CENTERS, cluster.filled_clusters(pools)).select("row_id", "cluster_id")


# -- sampling -------------------------------------------------------------------------------------

SPLIT = f"{ORDERS}, r AS (SELECT *, row_number() OVER (ORDER BY {_h(SEED, 'row_id')}, row_id) AS r, count(*) OVER () AS total FROM o)"
RESERVED = "r <= least(greatest(floor(0.1::DOUBLE * total), 1), total - 1)"


@query(f"WITH {SPLIT} SELECT row_id, ({RESERVED})::INT AS reserved FROM r")
def disjoint_split(spark, d):
    a, b = sampling.disjoint_split(declared(spark, d, "orders"), 0.1, SEED)
    return a.select("row_id", F.lit(1).alias("reserved")).unionByName(b.select("row_id", F.lit(0).alias("reserved")))


@query(f"WITH {SPLIT} SELECT row_id, target FROM r WHERE NOT {RESERVED}")
def split_antijoin(spark, d):
    rows = declared(spark, d, "orders")
    a, _ = sampling.disjoint_split(rows, 0.1, SEED)
    return rows.join(a.select("row_id"), "row_id", "left_anti").select("row_id", "target")


@query(f"WITH {SPLIT} SELECT count(*) AS common FROM (SELECT row_id FROM r WHERE {RESERVED} INTERSECT SELECT row_id FROM r WHERE NOT {RESERVED})")
def key_intersection_empty(spark, d):
    a, b = sampling.disjoint_split(declared(spark, d, "orders"), 0.1, SEED)
    return a.select("row_id").intersect(b.select("row_id")).agg(F.count(F.lit(1)).alias("common"))


BALANCED = f"b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {_h(SEED, 'row_id')}, row_id) AS r FROM o) WHERE r <= least(50, (SELECT min(n) FROM (SELECT count(*) AS n FROM o GROUP BY target))))"


@query(f"WITH {ORDERS}, {BALANCED} SELECT row_id, {_r('o_totalprice', 9)} AS o_totalprice, o_orderstatus, target FROM b")
def balanced_eval(spark, d):
    return r6(sampling.balanced(declared(spark, d, "orders"), 50, SEED), 9)


@query(f"WITH {ORDERS}, {BALANCED} SELECT target, count(*) AS n FROM b GROUP BY target")
def union_all_balanced(spark, d):
    return sampling.balanced(declared(spark, d, "orders"), 50, SEED).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def _demo_sql(queries: str, pool: str, shots: int) -> str:
    m = "CASE WHEN y = 1 THEN n1 ELSE n0 END"
    want = "CASE WHEN y = 1 THEN k1 ELSE k - k1 END"
    nth = "CASE WHEN y = 1 THEN slot ELSE slot - k1 END"
    return f"""pl AS ({pool}), rk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {_h(SEED, repr_('pool'), 'pool_id')}, pool_id) - 1 AS pos FROM pl),
  sz AS (SELECT count(*) FILTER (WHERE target = 1) AS n1, count(*) FILTER (WHERE target = 0) AS n0 FROM pl), qs AS ({queries}),
  q AS (SELECT query_id, n1, n0, least({shots}, n1 + n0) AS k FROM qs CROSS JOIN sz),
  q1 AS (SELECT *, CASE WHEN n1 = 0 THEN 0 WHEN n0 = 0 THEN k ELSE k // 2 END AS k1 FROM q WHERE k > 0),
  s AS (SELECT *, unnest(range(k)) AS slot FROM q1), s1 AS (SELECT *, (slot < k1)::INT AS y FROM s),
  s2 AS (SELECT *, CASE WHEN {want} <= {m} THEN (floor({_u(SEED, repr_('start'), 'query_id', 'y')} * {m}) + {nth}) % ({m}) ELSE floor({_u(SEED, repr_('draw'), 'query_id', 'slot')} * {m}) END::BIGINT AS pos,
    row_number() OVER (PARTITION BY query_id ORDER BY {_h(SEED + 3, 'query_id', 'slot')}, slot)::INT AS demo_rank FROM s1)
  SELECT query_id, demo_rank, pool_id, target FROM s2 JOIN rk ON rk.target = s2.y AND rk.pos = s2.pos"""


_Q = "SELECT row_id AS query_id FROM b"
_PARTS = f"WITH {ORDERS}, {BALANCED}, "


def _demos(spark, d, pool_filter: str, shots: int = 8):
    rows = declared(spark, d, "orders")
    queries = sampling.balanced(rows, 50, SEED).select(F.col("row_id").alias("query_id"))
    pool = rows.filter(pool_filter).select(F.col("row_id").alias("pool_id"), "target")
    return sampling.balanced_demos(queries, pool, shots, SEED)


@query(_PARTS + _demo_sql(_Q, "SELECT row_id AS pool_id, target FROM o", 8))
def balanced_demos(spark, d):
    return _demos(spark, d, "true")


@query(_PARTS + _demo_sql(_Q, "SELECT row_id AS pool_id, target FROM o WHERE target = 0 OR o_totalprice >= 0.995", 16))
def demos_with_replacement(spark, d):
    return _demos(spark, d, "target = 0 OR o_totalprice >= 0.995", 16)  # few rows of class 1


@query(_PARTS + _demo_sql(_Q, "SELECT row_id AS pool_id, target FROM o WHERE target = 1", 3))
def demos_single_class(spark, d):
    return _demos(spark, d, "target = 1", 3)


@query(f"WITH {ORDERS}, {BALANCED} SELECT q.row_id AS query_id, q.cl AS cluster_id, p.row_id AS pool_id FROM (SELECT row_id, {_nearest()} AS cl FROM b) q JOIN (SELECT row_id, {_nearest()} AS cl FROM o) p USING (cl)")
def route_pool_join(spark, d):
    rows = declared(spark, d, "orders")
    queries = cluster.assign(sampling.balanced(rows, 50, SEED), SPEC, CENTERS).select(F.col("row_id").alias("query_id"), "cluster_id")
    pools = cluster.assign(rows, SPEC, CENTERS).select("cluster_id", F.col("row_id").alias("pool_id"))
    return pools.join(F.broadcast(queries), "cluster_id").select("query_id", "cluster_id", "pool_id")  # 100 queries at most


@query(f"WITH {ORDERS} SELECT row_id FROM o WHERE {_u(SEED, repr_('bernoulli'), 'row_id')} < 0.3")
def bernoulli_subsample(spark, d):
    return privacy.bernoulli(declared(spark, d, "orders"), 0.3, SEED).select("row_id")


@query(_shots_sql(10, 4))
def resample_k(spark, d):
    """Ten rows of four prototypes, drawn with replacement."""
    return r6(privacy.dp_group_by(declared(spark, d, "orders"), DECLARED["orders"], 2.0, 10, Noise.test(SEED), ["target", "o_orderstatus"], seed=SEED))


# -- text -----------------------------------------------------------------------------------------


@query("SELECT c_custkey, coalesce(substr(c_name, 1, 60), 'NA') AS name, coalesce(printf('%.4f', c_nationkey + 0.25), 'NA') AS number FROM customer")
def fmt_value(spark, d):
    df = read_parquet(spark, d, "customer")
    return df.select("c_custkey", exprs.format_value(F.col("c_name"), False).alias("name"), exprs.format_value(F.col("c_nationkey") + F.lit(0.25), True).alias("number"))


_C = DECLARED["customer"]
_CVIEW = "c AS (SELECT c_custkey, (c_custkey % 1000 + 0.5)::DOUBLE AS c_acctbal, c_nationkey::VARCHAR AS c_nationkey, (c_mktsegment = 'BUILDING')::INT AS target FROM customer)"


def _customers(spark, d):
    df = read_parquet(spark, d, "customer")
    return df.select("c_custkey", (F.col("c_custkey") % 1000 + 0.5).cast("double").alias("c_acctbal"), F.col("c_nationkey").cast("string"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("target"))


@query(f"WITH {_CVIEW} SELECT c_custkey, '{prompt.CENSUS_INTRO}; c acctbal is ' || replace(printf('%.4f', c_acctbal), '-', ' ') || '; c nationkey is ' || c_nationkey || '.' AS text FROM c")
def serialize_list(spark, d):
    df = _customers(spark, d)
    return df.select("c_custkey", prompt.serialize_list(df, _C).alias("text"))


_JSON = """'{"c_acctbal":"' || printf('%.4f', c_acctbal) || '","c_nationkey":"' || c_nationkey || '"}'"""


@query(f"WITH {_CVIEW} SELECT c_custkey, {_JSON} AS text FROM c")
def serialize_json(spark, d):
    df = _customers(spark, d)
    return df.select("c_custkey", prompt.serialize_json(df, _C).alias("text"))


@query(
    f"WITH {_CVIEW} SELECT c_custkey, 'An instance from the segment prediction dataset is described as follows: c acctbal is ' || printf('%.4f', c_acctbal) || '; c nationkey is ' || c_nationkey || '. Is the correct label positive? Yes or No? Answer: ' || CASE target WHEN 1 THEN 'Yes' ELSE 'No' END AS text FROM c"
)
def serialize_sentence(spark, d):
    df = _customers(spark, d)
    return df.select("c_custkey", prompt.serialize_sentence(df, _C, True).alias("text"))


_PQ = "q AS (SELECT c_custkey AS query_id, (c_nationkey / 32.0)::DOUBLE AS c_acctbal, c_nationkey::VARCHAR AS c_nationkey, (c_mktsegment = 'BUILDING')::INT AS target FROM customer)"
_PJ = """'{"c_acctbal":"' || printf('%.4f', round(c_acctbal * 11000.0::DOUBLE - 1000.0::DOUBLE, 2)) || '","c_nationkey":"' || c_nationkey || '"}'"""


@query(
    f"WITH {_PQ} SELECT query_id, 'Follow the labeled examples. Output exactly one label: 0 or 1.' AS system_message, 'Use the labeled examples to perform segment prediction for the query instance.' || chr(10) || 'Allowed labels: 0 or 1.' || chr(10) || 'Return only 0 or 1.' || chr(10) || chr(10)"
    + " || 'Example 1:' || chr(10) || 'Input: {\"c_acctbal\":\"4500.0000\",\"c_nationkey\":\"3\"}' || chr(10) || 'Label: 1' || chr(10) || chr(10) || 'Example 2:' || chr(10) || 'Input: {\"c_acctbal\":\"1750.0000\",\"c_nationkey\":\"5\"}' || chr(10) || 'Label: 0' || chr(10) || chr(10)"
    + f" || 'Query:' || chr(10) || 'Input: ' || {_PJ} || chr(10) || 'Label:' AS user_message FROM q"
)
def prompt_messages(spark, d):
    df = read_parquet(spark, d, "customer")
    queries = df.select(F.col("c_custkey").alias("query_id"), (F.col("c_nationkey") / 32.0).alias("c_acctbal"), F.col("c_nationkey").cast("string"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("target"))
    shots = spark.createDataFrame([(1, 0.5, "3", 1), (2, 0.25, "5", 0)], "demo_rank int, c_acctbal double, c_nationkey string, target int")
    return prompt.prompts(queries, queries.select("query_id").crossJoin(F.broadcast(shots)), _C)


@query(f"WITH {_CVIEW} SELECT c_custkey, 'sys' || chr(10) || chr(10) || 'Query: ' || c_nationkey || chr(10) || 'Label: ' AS prompt FROM c")
def prompt_suffix(spark, d):
    return _customers(spark, d).select("c_custkey", prompt.scorer_input(F.lit(" sys "), F.concat(F.lit("Query: "), F.col("c_nationkey"), F.lit("  "))).alias("prompt"))


_REPLIES = """r AS (SELECT conv_id, turn, text IS NOT NULL AND turn % 4 <> 1 AS object, length(text) % 10 / 10.0::DOUBLE AS a, least(turn, 1)::DOUBLE AS b FROM conversations),
  w AS (SELECT conv_id, turn, CASE WHEN object THEN a ELSE 0.5::DOUBLE END AS a, CASE WHEN object THEN b ELSE 0.5::DOUBLE END AS b FROM r)"""


def _replies(spark, d):
    """Replies around the conversations' texts: objects with a key's quote missing and a comma too many, and no objects."""
    text = F.translate("text", "{}", "()")
    reply = F.concat(text, F.lit(' {a": 0.'), F.length("text") % 10, F.lit(', "b": '), F.col("turn"), F.lit(",} done"))
    return read_parquet(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 1, text).otherwise(reply).alias("reply"))


@query(f"WITH {_REPLIES} SELECT * FROM w")
def json_extract_weights(spark, d):
    w = prompt.parse_weights(F.col("reply"), ["a", "b"])
    return r6(_replies(spark, d).select("conv_id", "turn", w["a"].alias("a"), w["b"].alias("b")))


@query(f"WITH {_REPLIES} SELECT conv_id, turn, {_r('CASE WHEN a + b > 0 THEN 2 * a / (a + b) ELSE 1 END')} AS a, {_r('CASE WHEN a + b > 0 THEN 2 * b / (a + b) ELSE 1 END')} AS b FROM w")
def weight_normalize(spark, d):
    w = prompt.normalize_weights(prompt.parse_weights(F.col("reply"), ["a", "b"]), ["a", "b"])
    return r6(_replies(spark, d).select("conv_id", "turn", w["a"].alias("a"), w["b"].alias("b")))


@query(f"WITH p AS ({_group_sql(INF, ['target'])}) SELECT target, 'Class summary (label=' || target || '): o_totalprice=' || printf('%.2f', o_totalprice * 500000.0::DOUBLE) || ', o_orderstatus=' || o_orderstatus AS line FROM p")
def class_summary_lines(spark, d):
    prototypes = r6(privacy.class_prototypes(declared(spark, d, "orders"), DECLARED["orders"], INF, Noise.test(SEED)))
    return prototypes.select("target", prompt.summary_line(DECLARED["orders"]).alias("line"))


@query(
    f"""WITH p AS ({_group_sql(INF, ['target'])}), z AS (SELECT max(v) FILTER (WHERE target = 0) AS v0, max(v) FILTER (WHERE target = 1) AS v1 FROM (SELECT target, round(o_totalprice * 500000.0::DOUBLE, 2) AS v FROM p)), {ORDERS}
  SELECT row_id AS query_id, (abs(round(o_totalprice * 500000.0::DOUBLE, 2) - v1) < abs(round(o_totalprice * 500000.0::DOUBLE, 2) - v0))::INT AS prediction FROM o CROSS JOIN z"""
)
def text_scorer_labels(spark, d):
    """Every order as a prompt with the two class prototypes for demonstrations; the model's stand-in reads prices out of the prompt's text."""
    import re

    s = DECLARED["orders"]
    rows = declared(spark, d, "orders")
    shots = r6(privacy.class_prototypes(rows, s, INF, Noise.test(SEED))).select((F.col("key_id") + 1).alias("demo_rank"), *s.features, "target")
    queries = rows.withColumnRenamed("row_id", "query_id")

    def load():
        def scores(texts):
            found = [[float(x) for x in re.findall(r'"o_totalprice":"([0-9.]+)"', t)] for t in texts]  # example of label 0, of label 1, query
            return score.max_label_scores([{" 0": -abs(q - zero), "1": -abs(q - one)} for zero, one, q in found])

        return scores

    return experiment.prompt_scorer(s, score.text_scorer(load))(queries, queries.select("query_id").crossJoin(F.broadcast(shots)), "query_id")  # two rows


# -- metrics --------------------------------------------------------------------------------------

_METRICS = f"""SELECT tp, fp, fn, tn, {_r('(tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE')} AS accuracy, {_r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)')} AS f1,
  {_r('coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)')} AS "precision", {_r('coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)')} AS recall FROM
  (SELECT count(*) FILTER (WHERE t = 1 AND p = 1) AS tp, count(*) FILTER (WHERE t = 0 AND p = 1) AS fp, count(*) FILTER (WHERE t = 1 AND p = 0) AS fn, count(*) FILTER (WHERE t = 0 AND p = 0) AS tn FROM x)"""


@query("WITH x AS (SELECT quality AS t, 1 - toxic AS p FROM labels) " + _METRICS)
def binary_metrics(spark, d):
    df = read_parquet(spark, d, "labels").select(F.col("quality").alias("t"), (1 - F.col("toxic")).alias("p"))
    return r6(score.metrics(df, "t", "p"))


@query("WITH x AS (SELECT quality AS t, 0 AS p FROM labels) " + _METRICS)
def metrics_zero_division(spark, d):
    return r6(score.metrics(read_parquet(spark, d, "labels").select(F.col("quality").alias("t"), F.lit(0).alias("p")), "t", "p"))


_FAR = [*CENTERS, [9.0] * 4]  # a cluster that nothing is near to


@query(f"WITH {ORDERS}, a AS (SELECT DISTINCT {_nearest((0, 1, 2, 3), _FAR)} AS id FROM o) SELECT 4::BIGINT - count(*) AS fallback_clusters FROM a")
def fallback_count(spark, d):
    """Clusters without a positive cell in their tables."""
    s = DECLARED["orders"]
    coded = marginals.encode_rows(cluster.assign(declared(spark, d, "orders"), SPEC, _FAR), s, keep=["cluster_id"])
    models = synth.cluster_models(coded, synth.MarginalMethod(marginals.sizes(s), INF), len(_FAR), Noise.test(SEED))
    return synth.fallback_count(spark.createDataFrame([(c, m is None) for c, m in enumerate(models)], "cluster_id int, fallback boolean"))


# -- synthesis and experiments -----------------------------------------------------------------------

_STAR_PAIRS = CODED_ORDERS + ", m AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS attr_a, x AS code_a, y AS code_b, coalesce(n, 0)::DOUBLE AS n FROM (SELECT unnest(range({s})) AS x) CROSS JOIN (SELECT unnest(range(2)) AS y) LEFT JOIN (SELECT {a} AS x, target AS y, count(*) AS n FROM c GROUP BY ALL) USING (x, y)"
    for a, s in (("o_totalprice", 8), ("o_orderstatus", 3))
) + ")"


@query(
    f"""WITH {_STAR_PAIRS}, cdf AS (SELECT *, CASE WHEN sum(n) OVER w > 0 THEN sum(n) OVER (w ORDER BY code_a ROWS UNBOUNDED PRECEDING) / sum(n) OVER w ELSE count(*) OVER (w ORDER BY code_a ROWS UNBOUNDED PRECEDING) / count(*) OVER w END AS upto FROM m WINDOW w AS (PARTITION BY attr_a, code_b)),
  p AS (SELECT avg(p) AS p FROM (SELECT sum(n) FILTER (WHERE code_b = 1) / sum(n) AS p FROM m GROUP BY attr_a)),
  s AS (SELECT range AS synth_id, ({_u(SEED, repr_('y'), 'range')} < p.p)::INT AS target FROM range(500) CROSS JOIN p)
  SELECT synth_id, (SELECT min(code_a) FROM cdf WHERE attr_a = 'o_totalprice' AND code_b = s.target AND upto >= {_u(SEED, repr_('x'), repr_('o_totalprice'), 's.synth_id')})::INT AS o_totalprice,
    (SELECT min(code_a) FROM cdf WHERE attr_a = 'o_orderstatus' AND code_b = s.target AND upto >= {_u(SEED, repr_('x'), repr_('o_orderstatus'), 's.synth_id')})::INT AS o_orderstatus, target FROM s"""
)
def star_synth(spark, d):
    s = DECLARED["orders"]
    coded = marginals.encode_rows(declared(spark, d, "orders"), s)
    pairs = marginals.pair_marginals(coded, marginals.target_star(s.features), marginals.sizes(s))
    noisy = synth.noisy_pairs(pairs, INF, 1e-5, Noise.test(SEED), 2)
    return synth.star_synthesize(noisy, s.features, 500, Noise.test(SEED))


@query()
def marginal_synth(spark, d):
    return r6(synth.marginal_synthesize(declared(spark, d, "lineitem"), DECLARED["lineitem"], 4.0, 2000, Noise.test(SEED), target_only=False))


@query()
def generator_synth(spark, d):
    return r6(synth.generator_synthesize(declared(spark, d, "lineitem"), DECLARED["lineitem"], 4.0, 2000, Noise.test(SEED), seed=SEED))


_STAR_SIGMA = synth.gauss_sigma(synth.zcdp(2.0, 1e-5) / 2)
_MIDS = [(x + y) / 2 for x, y in zip(exprs.edges(8), exprs.edges(8)[1:])]
_CLUSTER_STAR = f"""WITH {CODED_ORDERS}, cc AS (SELECT c.*, {_nearest()} AS cluster_id FROM c JOIN (SELECT row_id, o_totalprice AS p, o_orderstatus AS s FROM o) USING (row_id)), m AS (""" + " UNION ALL ".join(
    f"SELECT cluster_id, '{a}' AS attr_a, x AS code_a, y AS code_b, greatest(coalesce(n, 0) + {_dnorm(_STAR_SIGMA, SEED, repr_('cell'), 'cluster_id', repr_(a), repr_('target'), 'x', 'y')}, 0) AS n FROM (SELECT DISTINCT cluster_id FROM cc) CROSS JOIN (SELECT unnest(range({s})) AS x) CROSS JOIN (SELECT unnest(range(2)) AS y) LEFT JOIN (SELECT cluster_id, {a} AS x, target AS y, count(*) AS n FROM cc GROUP BY ALL) USING (cluster_id, x, y)"
    for a, s in (("o_totalprice", 8), ("o_orderstatus", 3))
) + f"""), cdf AS (SELECT *, CASE WHEN sum(n) OVER w > 0 THEN sum(n) OVER (w ORDER BY code_a ROWS UNBOUNDED PRECEDING) / sum(n) OVER w ELSE count(*) OVER (w ORDER BY code_a ROWS UNBOUNDED PRECEDING) / count(*) OVER w END AS upto FROM m WINDOW w AS (PARTITION BY cluster_id, attr_a, code_b)),
  p AS (SELECT cluster_id, coalesce(avg(p), 0.5) AS p FROM (SELECT cluster_id, sum(n) FILTER (WHERE code_b = 1) / nullif(sum(n), 0) AS p FROM m GROUP BY cluster_id, attr_a) GROUP BY cluster_id),
  s AS (SELECT cluster_id, range AS synth_id, ({_u(SEED, repr_('y'), 'cluster_id', 'range')} < p.p)::INT AS target FROM range(300) CROSS JOIN p),
  d AS (SELECT cluster_id, synth_id, (SELECT min(code_a) FROM cdf WHERE cdf.cluster_id = s.cluster_id AND attr_a = 'o_totalprice' AND code_b = s.target AND upto >= {_u(SEED, repr_('x'), repr_('o_totalprice'), 's.cluster_id', 's.synth_id')}) AS a,
    (SELECT min(code_a) FROM cdf WHERE cdf.cluster_id = s.cluster_id AND attr_a = 'o_orderstatus' AND code_b = s.target AND upto >= {_u(SEED, repr_('x'), repr_('o_orderstatus'), 's.cluster_id', 's.synth_id')}) AS b, target FROM s)
  SELECT cluster_id, synth_id, {_r(str(_MIDS) + "[a + 1]")} AS o_totalprice, ['F','O','P'][b + 1] AS o_orderstatus, target FROM d"""


@query(_CLUSTER_STAR.replace(_nearest(), _nearest().replace("o_totalprice", "p").replace("o_orderstatus", "s")))
def cluster_star_synth(spark, d):
    s = DECLARED["orders"]
    assigned = cluster.assign(declared(spark, d, "orders"), SPEC, CENTERS)
    coded = marginals.encode_rows(assigned, s, keep=["cluster_id"])
    pairs = marginals.pair_marginals(coded, marginals.target_star(s.features), marginals.sizes(s), by=["cluster_id"])
    noisy = synth.noisy_pairs(pairs, 2.0, 1e-5, Noise.test(SEED), 2, by=["cluster_id"])
    return r6(synth.decode_rows(synth.star_synthesize(noisy, s.features, 300, Noise.test(SEED), by="cluster_id"), s, 8, ["cluster_id", "synth_id"]))


@query()
def experiment_end_to_end(spark, d):
    ctx = experiment.prepare_dataset(spark, "orders", d)
    return r6(experiment.run_experiments(spark, experiment.MarginalBackend(noise=Noise.test), [ctx], trials=1, ks=(2,), epsilons=(2.0,), n_synth=400, noise=Noise.test))


def _example(price: str, status: str) -> str:
    return f"""'Input: {{"o_totalprice":"' || printf('%.4f', round({price} * 500000.0::DOUBLE, 2)) || '","o_orderstatus":"' || {status} || '"}}' || chr(10) || 'Label:'"""


_EVAL_SPLIT = f"""{ORDERS}, sp AS (SELECT *, row_number() OVER (ORDER BY {_h(experiment.EVAL_SEED, 'row_id')}, row_id) AS r, count(*) OVER () AS total FROM o),
  te AS (SELECT * FROM sp WHERE r <= least(greatest(floor(0.2::DOUBLE * total), 1), total - 1)),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {_h(experiment.EVAL_SEED, 'row_id')}, row_id) AS nth FROM te) WHERE nth <= least(50, (SELECT min(n) FROM (SELECT count(*) AS n FROM te GROUP BY target))))"""


@query(
    f"""WITH {_EVAL_SPLIT}, sl AS (SELECT row_id AS query_id, unnest(range(4)) AS slot FROM b), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_h(3, 'query_id', 'slot')}, slot) AS nth FROM sl),
  ex AS (SELECT query_id, string_agg('Example ' || nth || ':' || chr(10) || {_example(repr(encode.decode_center(SPEC, CENTERS[0])['o_totalprice']), repr_('F'))} || ' ' || (slot < 2)::INT || chr(10) || chr(10), '' ORDER BY nth) AS examples FROM rk GROUP BY query_id)
  SELECT query_id, 'Follow the labeled examples. Output exactly one label: 0 or 1.' || chr(10) || chr(10) || 'Use the labeled examples to perform order urgency prediction for the query instance.' || chr(10) || 'Allowed labels: 0 or 1.' || chr(10) || 'Return only 0 or 1.' || chr(10) || chr(10)
  || examples || 'Query:' || chr(10) || {_example('o_totalprice', 'o_orderstatus')} || ' ' AS prompt FROM ex JOIN b ON b.row_id = ex.query_id"""
)
def evaluation_prompts(spark, d):
    ctx = experiment.prepare_dataset(spark, "orders", d)
    pool = synth.centroid_fallback(spark, encode.decode_center(SPEC, CENTERS[0]), ctx.schema, 12).withColumn("cluster_id", F.lit(0))
    return experiment.evaluation_prompts(experiment.constant_pool(ctx.evaluation), pool, ctx.schema, shots=4)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DP class prototypes of the reserved weighting part of ``orders``."""
    reserved, _ = sampling.disjoint_split(declared(spark, sf_dir, "orders"), 0.1, experiment.SPLIT_SEED)
    return privacy.class_prototypes(reserved, DECLARED["orders"], 1.0, Noise.test(SEED))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

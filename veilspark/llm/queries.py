"""The registered ``opN_*`` queries: each operator over its whole table, and SQL where it fits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bestfit, exact_dedup, html_text, mixing, packing, periodic, quality, repeats, sharding, simhash, toxicity, variants
from .shared import WHITE, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).drop("row_number")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def repeating(doc_id: Column, text: Column) -> Column:
    """The text, of each document whose h = crc32(doc_id) is a multiple of ten with its words from a = g % n on repeated every p words."""
    g = F.floor(F.crc32(doc_id.cast("string")) / 10)
    words = F.filter(F.split(text, WHITE), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, 1, a), F.slice(tail, 1, n - a)), " ")

    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)))[0]
    return F.when(F.crc32(doc_id.cast("string")) % 10 == 0, planted).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeating(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs).withColumn("top", F.expr(periodic.longest()))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_whole(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def misspelt(doc_id: Column, run: Column) -> Column:
    """The run, or without its code point h % length if 199 divides h = crc32("<doc_id>:<run>")."""
    h, n = F.crc32(F.concat_ws(":", doc_id.cast("string"), run)), F.length(run)
    at = (h % n).cast("int")
    return F.when(h % 199 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, n))).otherwise(run)


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(variants.letter_runs(F.col("text"))).alias("run")).filter(F.length("run") >= variants.MIN_LENGTH)
    lowered = runs.select("doc_id", variants.lower_ascii(F.col("run")).alias("run"))
    return variants.group_variants(lowered.select(misspelt(F.col("doc_id"), F.col("run")).alias("word")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_packing, op3_mixing, op4_html_text, op5_repeats, op6_toxicity, op7_sharding, op8_quality, op9_simhash, op10_ann, op11_periodic_runs, op12_bestfit, op13_variants)}


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), k AS (SELECT doc_id, sha256(norm) AS text_sha256, norm FROM d)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM k WINDOW w AS (PARTITION BY norm)
"""


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('1729:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s0 AS (SELECT k, sum(size)::BIGINT AS ss FROM d GROUP BY k),
s1 AS (SELECT k, ss, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s0),
s2 AS (SELECT *, ss * 3.0::DOUBLE AS stop, ss * 3.0::DOUBLE / w AS lv, (sum(ss) OVER ())::DOUBLE AS total, sum(w) OVER () AS aw FROM s1),
s3 AS (SELECT *, sum(stop) OVER f AS st, sum(w) OVER f AS wt FROM s2 WINDOW f AS (ORDER BY lv, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s4 AS (SELECT *, st + lv * (aw - wt) <= total AS fullup FROM s3),
s5 AS (SELECT *, CASE WHEN fullup THEN stop ELSE least(w * (total - sum(CASE WHEN fullup THEN stop ELSE 0 END) OVER ())
         / (aw - sum(CASE WHEN fullup THEN w ELSE 0 END) OVER ()), stop) END AS target FROM s4),
c0 AS (SELECT k, length(bin(size)) AS w, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
c1 AS (SELECT *, (sum(words) OVER l)::DOUBLE AS top, (sum(words * w) OVER (PARTITION BY k) - sum(words * w) OVER l)::DOUBLE AS low FROM c0 JOIN (SELECT k, ss, target FROM s5) USING (k) WINDOW l AS (PARTITION BY k ORDER BY w DESC)),
c2 AS (SELECT *, 3.0::DOUBLE * top + 3.0::DOUBLE / w * low <= target AS full_ FROM c1),
c3 AS (SELECT *, (target - 3.0::DOUBLE * coalesce(sum(CASE WHEN full_ THEN words END) OVER (PARTITION BY k), 0)::DOUBLE) / (sum(CASE WHEN NOT full_ THEN words * w END) OVER (PARTITION BY k))::DOUBLE AS rate FROM c2),
c4 AS (SELECT *, CASE WHEN full_ THEN 3.0::DOUBLE ELSE least(rate * w, 3.0::DOUBLE) END AS e FROM c3),
c5 AS (SELECT k, w, ss, target, words, e - floor(e) AS p, floor(e)::BIGINT AS whole FROM c4),
c6 AS (SELECT *, greatest(target - (sum(words * whole) OVER (PARTITION BY k))::DOUBLE, 0.0::DOUBLE) AS goal FROM c5),
r0 AS (SELECT d.*, ss, target, whole, goal, CASE WHEN size > 0 AND p > 0 AND p < 1 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS q FROM d JOIN c6 ON d.k = c6.k AND length(bin(d.size)) = c6.w),
r1 AS (SELECT *, q / (1.0::DOUBLE + q) AS y FROM r0),
r2 AS (SELECT *, coalesce(y IS NOT NULL AND sum(size) OVER (PARTITION BY k, y IS NULL ORDER BY y) <= goal, false) AS a FROM r1),
r3 AS (SELECT *, goal - coalesce(sum(size) FILTER (WHERE a) OVER (PARTITION BY k), 0) AS room FROM r2),
r4 AS (SELECT *, y IS NOT NULL AND NOT a AND size <= room AS c FROM r3),
r5 AS (SELECT *, c AND sum(size) OVER (PARTITION BY k, c ORDER BY y) <= room AS b FROM r4),
r6 AS (SELECT *, room - coalesce(sum(size) FILTER (WHERE b) OVER (PARTITION BY k), 0) AS room2, whole + (a OR b)::BIGINT AS n FROM r5),
-- the last change: up to three of about 24 documents come, and up to three go
ch AS (SELECT k, u, sum(size)::BIGINT AS size, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY k) AS held FROM r6 WHERE size > 0) WHERE u * held <= 24 GROUP BY k, u),
mv AS (SELECT 0 AS go, * EXCLUDE (n) FROM ch WHERE n < 3 UNION ALL SELECT 1, * EXCLUDE (n) FROM ch WHERE n > 0),
m1 AS (SELECT go, k, size AS s, [u] AS us FROM mv),
m2 AS (SELECT m.go, m.k, s + size AS s, list_append(us, u) AS us FROM m1 m JOIN mv ON m.go = mv.go AND m.k = mv.k AND us[-1] < u),
m3 AS (SELECT m.go, m.k, s + size AS s, list_append(us, u) AS us FROM m2 m JOIN mv ON m.go = mv.go AND m.k = mv.k AND us[-1] < u),
sm AS (SELECT go, k, s, min(us) AS us FROM (FROM m1 UNION ALL FROM m2 UNION ALL FROM m3) GROUP BY ALL),
sn AS (FROM sm UNION ALL SELECT go, k, 0, []::DOUBLE[] FROM (SELECT DISTINCT k FROM r6), (SELECT unnest([0, 1]) AS go)),
rm AS (SELECT DISTINCT k, room2 FROM r6),
ask AS (SELECT k, s AS d, us AS gone, room2, room2 + s AS goal FROM sn JOIN rm USING (k) WHERE go = 1),
off AS (SELECT k, s::DOUBLE AS a, us AS come FROM sn WHERE go = 0),
pr AS (SELECT ask.*, off.a, off.come FROM ask ASOF JOIN off ON ask.k = off.k AND ask.goal >= off.a UNION ALL SELECT ask.*, off.a, off.come FROM ask ASOF JOIN off ON ask.k = off.k AND ask.goal <= off.a),
pick AS (SELECT k, come, gone FROM (SELECT *, abs(goal - a) AS miss FROM pr) WHERE miss < room2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY miss, d, a) = 1)
SELECT doc_id, size, ss AS source_size, target,
       CASE WHEN size > 0 THEN size * (n + coalesce(list_contains(come, u), false)::BIGINT - coalesce(list_contains(gone, u), false)::BIGINT) ELSE 0 END AS taken
FROM r6 LEFT JOIN pick USING (k)
"""


#: CRC-32 of a list of bytes b: the table of its 256 steps t, and a fold over both.
CRC_STEPS = "t AS (SELECT list(list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS s FROM range(256) r(v))"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {b}), lambda c, x: xor(c >> 8, s[(xor(c, x) & 255) + 1])), 4294967295)"


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text in UTF-8; t is in scope."""
    return CRC.format(b=f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INT + 1, 2))::BIGINT)")


OP11_SQL = rf"""
WITH {CRC_STEPS},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {crc_sql("doc_id::VARCHAR")} AS h FROM documents, t),
g AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
x AS (SELECT r, n, unnest(range(n)) AS i, unnest(CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) END) AS word FROM p),
-- matches i, i + q of equal words; islands are unbroken in i
m AS (SELECT l.r, l.i, o.i - l.i AS q FROM x l JOIN x o ON l.r = o.r AND l.word = o.word AND o.i > l.i AND o.i - l.i <= l.n // 4),
c AS (SELECT r, q, min(i) AS start, count(*) AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m) GROUP BY r, q, island),
-- a stretch with two periods counts with the smaller one
runs AS (SELECT r, start, k + q AS length, min(q) AS period FROM c WHERE k >= greatest(6 - q, 3 * q) GROUP BY ALL),
drops AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN drops USING (r, i) GROUP BY r),
best AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
top AS (SELECT r, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN top USING (r) LEFT JOIN kept USING (r)
"""


OP13_SQL = rf"""
WITH RECURSIVE {CRC_STEPS},
x AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
y AS (SELECT doc_id, run, count(*) AS c FROM x WHERE length(run) >= 6 GROUP BY ALL),
z AS (SELECT run, c, {crc_sql("coalesce(doc_id::VARCHAR || ':', '') || run")} AS h FROM y, t),
v AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM z),
w AS (SELECT word, sum(c)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
k AS (SELECT word, n, unnest(range(-1, length(word))) AS i, unnest(list_prepend(word, list_transform(range(length(word)), lambda i: left(word, i) || substr(word, i + 2)))) AS k FROM w),
-- one code point replaced: the same place is deleted in both; else one word is a deletion of the other
near AS (SELECT DISTINCT l.word, l.n, o.word AS other, o.n AS other_n FROM k l JOIN k o ON l.k = o.k AND l.word <> o.word AND (l.i = o.i OR l.i = -1 OR o.i = -1)),
f AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS best, max(other_n) AS best_n FROM near GROUP BY word),
e AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM w LEFT JOIN f USING (word)),
way AS (SELECT word, coalesce(form, word) AS stop FROM e UNION SELECT way.word, e.form FROM way JOIN e ON way.stop = e.word WHERE e.form IS NOT NULL)
SELECT word, form, way.stop AS root, n, n_near, form_n FROM e JOIN way USING (word) WHERE way.stop IN (SELECT word FROM e WHERE form IS NULL)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_periodic_runs": OP11_SQL, "op13_variants": OP13_SQL, "op1_exact_dedup": OP1_SQL, "op3_mixing": OP3_SQL}

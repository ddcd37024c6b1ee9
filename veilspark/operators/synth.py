"""Synthetic pools: star sampler, marginal method with gradual update, generator, centroid fallback.

Neighbouring tables differ by one added or removed row, for every method: it moves one cell of each table by one,
so no noise scale depends on how many rows there are, and a row belongs to one cluster, so clusters that are
disjoint are charged once. Private rows are touched by one pass for all clusters together: it
counts dense tables of public size by cluster. A method turns a cluster's noisy tables into a model (one small task a
cluster); models reach the driver (as many numbers as the public grid and the method's size allow,
whatever the number of rows) and rows are drawn from them block by block, in as many tasks as a pool has blocks.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import col, decode, midpoint, target_code
from ..functions.rand import Noise, infinite
from ..sources.schema import PublicSchema, SchemaError
from .generator import GeneratorConfig, Mixture
from .marginals import all_pairs, encode_rows, marginal_tables, sizes, target_star


def zcdp(epsilon: float, delta: float) -> float:
    """The zero-concentrated budget rho that (epsilon, delta) allows."""
    root = math.sqrt(math.log(1 / delta) + epsilon) - math.sqrt(math.log(1 / delta))
    return root * root


def gauss_sigma(rho: float, sensitivity: float = 1.0) -> float:
    return sensitivity / math.sqrt(2 * rho)


def noisy_pairs(pairs: DataFrame, epsilon: float, delta: float, noise: Noise, n_tables: int, by: Sequence[str] = ()) -> DataFrame:
    """Pair cells with discrete Gaussian noise; rho is split evenly over the tables; negatives go to 0."""
    sigma = 0.0 if infinite(epsilon) else gauss_sigma(zcdp(epsilon, delta) / max(1, n_tables))
    z = noise.discrete_normal(sigma, "cell", *[F.col(b) for b in by], F.col("attr_a"), F.col("attr_b"), F.col("code_a"), F.col("code_b"))
    return pairs.withColumn("n", F.greatest(F.col("n") + z, F.lit(0)))


def star_synthesize(noisy: DataFrame, features: Sequence[str], n_synth: int, noise: Noise, by: str | None = None) -> DataFrame:
    """``n_synth`` coded rows (per group): the target first, then each feature given the target.

    Cumulative shares of the noisy tables are looked up by keyed uniforms: exact for the
    target star, no iteration. ``noisy``: pair cells with attr_b = 'target'.
    """
    keys = [by] if by else []
    spark = noisy.sparkSession
    cell = Window.partitionBy(*keys, "attr_a", "code_b").orderBy("code_a").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "attr_a", "code_b")
    share = lambda part, total, size: F.when(F.sum("n").over(total) > 0, F.sum("n").over(part) / F.sum("n").over(total)).otherwise(F.count(F.lit(1)).over(part) / size)
    given = noisy.withColumn("upto", share(cell, whole, F.count(F.lit(1)).over(whole)))
    tables = given.groupBy(*keys, "attr_a", "code_b").agg(F.sort_array(F.collect_list(F.struct("code_a", "upto"))).alias("cdf"))  # a public domain
    ones = noisy.groupBy(*keys, "attr_a").agg((F.sum(F.when(F.col("code_b") == 1, F.col("n"))) / F.sum("n")).alias("p"))
    target = ones.groupBy(*keys).agg(F.coalesce(F.avg("p"), F.lit(0.5)).alias("p1"))
    wide = tables.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "attr_a", "code_b").alias("k"), "cdf"))).alias("tables"))
    base = spark.range(n_synth).select(F.col("id").alias("synth_id"))
    plan = target.join(wide, keys) if keys else target.crossJoin(wide)
    rows = base.crossJoin(F.broadcast(plan))  # one row per cluster
    rows = rows.withColumn("target", (noise.uniform("y", *keys_cols(keys), F.col("synth_id")) < F.col("p1")).cast("int"))
    for f in features:
        u = noise.uniform("x", f, *keys_cols(keys), F.col("synth_id"))
        cdf = F.element_at("tables", F.concat_ws("|", F.lit(f), F.col("target").cast("string")))
        rows = rows.withColumn(f, look_up(cdf, u))
    return rows.select(*keys, "synth_id", *[col(f) for f in features], "target")


def look_up(cdf, u):
    """First code of an array of (code_a, upto) whose cumulative share reaches ``u``."""
    hit = F.filter(cdf, lambda c: c["upto"] >= u)
    return F.coalesce(F.try_element_at(hit, F.lit(1)), F.element_at(cdf, -1))["code_a"]


def keys_cols(keys: Sequence[str]) -> list:
    return [F.col(k) for k in keys]


def decode_rows(coded: DataFrame, schema: PublicSchema, bins: int, keep: Sequence[str] = ()) -> DataFrame:
    """Codes back to prepared rows: bin midpoints, category strings, 0/1 target."""
    return coded.select(
        *[col(k) for k in keep], *[midpoint(col(c), bins).alias(c) for c in schema.numeric],
        *[decode(col(c), schema.domain(c)).alias(c) for c in schema.categorical], target_code(F.col("target")).alias("target"),
    )


def validate_pool(pool: DataFrame, schema: PublicSchema) -> DataFrame:
    """The pool, if it has the prepared columns; a target other than 0 and 1 stops whatever reads it. Runs nothing by itself."""
    missing = [c for c in [*schema.features, "target"] if c not in pool.columns]
    if missing:
        raise SchemaError(f"pool lacks {missing}")
    wrong = F.raise_error(F.lit("pool has targets other than 0 and 1")).cast(pool.schema["target"].dataType)
    return pool.withColumn("target", F.when(F.col("target").isin(0, 1), F.col("target")).otherwise(wrong))


def simplex(v: np.ndarray, total: float) -> np.ndarray:
    """The nearest array without negatives and with the given sum: all cells go down (or up) alike, those that end below 0 stay at 0."""
    flat = np.sort(v.ravel())[::-1]
    above = flat - (np.cumsum(flat) - total) / np.arange(1, flat.size + 1)
    k = int(np.flatnonzero(above > 0)[-1]) + 1 if total > 0 else 0
    return np.maximum(v - (flat[:k].sum() - total) / k, 0.0) if k else np.zeros(v.shape)


def consistent(tables: Mapping[tuple[str, str], np.ndarray], rounds: int = 2, sigmas: Mapping[tuple[str, str], float] | None = None) -> dict[tuple[str, str], np.ndarray]:
    """Noisy pair tables made to agree on shared attributes and on one total, without negatives.

    The total and the shared views are means weighted by the inverse of their variance; negatives leave by
    projection, which keeps the sum: cutting them off alone would add rows wherever cells are empty.
    """
    sigma = {k: max(float((sigmas or {}).get(k, 1.0)), 1e-9) for k in tables}
    known = np.array([1.0 / (t.size * sigma[k] ** 2) for k, t in tables.items()])
    total = max(0.0, float((known * [t.sum() for t in tables.values()]).sum() / known.sum()))
    out = {k: simplex(v, total) for k, v in tables.items()}
    for _ in range(rounds):
        for a in sorted({x for k in out for x in k}):
            sides = [(k, k.index(a)) for k in out if a in k]
            # fewer cells summed into a view, less noise in it
            weights = np.array([1.0 / (out[k].shape[1 - i] * sigma[k] ** 2) for k, i in sides])
            views = np.array([out[k].sum(axis=1 - i) for k, i in sides])
            agreed = (weights[:, None] * views).sum(axis=0) / weights.sum()
            for (k, i), view in zip(sides, views):
                change = (agreed - view) / out[k].shape[1 - i]
                out[k] = out[k] + (change[:, None] if i == 0 else change[None, :])
        out = {k: simplex(t, total) for k, t in out.items()}
    return out


def choose_views(scores: Mapping[tuple[str, str], float], cells: Mapping[tuple[str, str], int], given: Sequence[tuple[str, str]], rho: float, most: int | None = None) -> list[tuple[str, str]]:
    """``given`` and the pairs that are worth their noise, the most useful first; at most ``most`` of them.

    A table left out costs the dependency that it would have shown, a table put in costs its expected noise, and
    takes budget from all others. The pair that lowers the sum most is added until none does.
    ``scores`` are noisy, so the choice is free.
    """
    chosen = list(given)

    def cost(views: Sequence[tuple[str, str]]) -> float:
        left_out = sum(max(v, 0.0) for k, v in scores.items() if k not in set(views))
        return left_out + sum(cells[k] * s * math.sqrt(2 / math.pi) for k, s in view_sigmas(cells, views, rho).items())

    now = cost(chosen)
    while most is None or len(chosen) - len(given) < most:
        rest = [(cost([*chosen, k]), k) for k in scores if k not in chosen and scores[k] > 0]
        if not rest or min(rest)[0] >= now:
            break
        now, best = min(rest)
        chosen.append(best)
    return chosen


def view_sigmas(cells: Mapping[tuple[str, str], int], views: Sequence[tuple[str, str]], rho: float) -> dict[tuple[str, str], float]:
    """The sigma of each table: budgets grow with the cells to the power of 2/3, which makes the sum of all noise least."""
    share = {k: cells[k] ** (2 / 3) for k in views}
    return {k: 0.0 if math.isinf(rho) else gauss_sigma(rho * v / sum(share.values())) for k, v in share.items()}


def gradual_update(tables: dict[tuple[str, str], np.ndarray], attributes: Mapping[str, int], n: int, rounds: int, seed: int) -> np.ndarray:
    """``n`` coded rows whose pair tables are moved towards ``tables``, from independent one-way samples.

    In each round and table, rows in cells with too many rows are recoded
    to cells with too few, a shrinking share at a time. Works on synthetic rows only.
    """
    rng = np.random.default_rng(seed)
    names = list(attributes)
    one = {}
    for a in names:
        views = [t.sum(axis=1 - k.index(a)) for k, t in tables.items() if a in k]
        one[a] = np.mean(views, axis=0) if views else np.ones(attributes[a])
    rows = np.stack([rng.choice(attributes[a], n, p=one[a] / one[a].sum() if one[a].sum() > 0 else None) for a in names], axis=1)
    for r in range(rounds):
        rate = 1.0 / (1 + 0.2 * r)
        for (a, b), t in tables.items():
            ia, ib = names.index(a), names.index(b)
            goal = t.ravel() / max(t.sum(), 1e-12) * n
            cell = rows[:, ia] * attributes[b] + rows[:, ib]
            have = np.bincount(cell, minlength=len(goal)).astype(float)
            gap = goal - have
            move = int(rate * np.maximum(gap, 0).sum())
            if move < 1:
                continue
            surplus = np.maximum(-gap, 0)
            odds = np.where(have[cell] > 0, surplus[cell] / np.maximum(have[cell], 1), 0)
            chosen = np.flatnonzero(rng.random(n) < odds * rate)
            if not len(chosen):
                continue
            want = np.maximum(gap, 0)
            new = rng.choice(len(goal), len(chosen), p=want / want.sum())
            rows[chosen, ia], rows[chosen, ib] = np.divmod(new, attributes[b])
    return rows


@dataclass
class ClusterLog:
    """``error`` tells why a cluster fell back to its decoded centre; nothing here is counted on private rows."""

    cluster_id: int
    fallback: bool
    error: str | None = None


class EmptyTables(ArithmeticError):
    """No noisy cell is positive: there is nothing to synthesise from."""


#: A cluster's exact tables inside a task: counts by set number, cell by cell.
Tables = Mapping[int, np.ndarray]


class Method(Protocol):
    """A synthesis strategy over counted tables. ``fit`` and ``draw`` run inside tasks; ``fit`` adds all noise."""

    attributes: Mapping[str, int]

    def sets(self) -> list[tuple[str, ...]]:
        """The attribute sets to count."""

    def fit(self, tables: Tables, cluster_id: int, noise: Noise):
        """A model made of noisy tables, or None if they are empty."""

    def draw(self, model, n: int, rng: np.random.Generator) -> np.ndarray:
        """``n`` coded rows."""


def noisy_table(n: np.ndarray, sigma: float, noise: Noise, cluster_id: int, set_id: int) -> np.ndarray:
    """Integer counts with discrete normal noise, a function of key, cluster, set and cell."""
    return n + np.array(noise.discrete_normals(sigma, ("cell", cluster_id, set_id), range(len(n))), np.int64)


@dataclass
class MarginalMethod:
    """Noisy pair tables, made consistent; rows start from one-way tables and are updated gradually towards the pairs.

    With ``target_only``, every feature's table with the target is measured. Else a tenth of rho buys
    noisy dependency scores of all pairs, and up to ``view_rounds`` pairs beyond the star are added if they are worth their noise.
    """

    attributes: Mapping[str, int]
    epsilon: float
    delta: float = 1e-5
    consistency_rounds: int = 2
    view_rounds: int = 10
    update_rounds: int = 20
    target_only: bool = True

    def sets(self) -> list[tuple[str, ...]]:
        features = [a for a in self.attributes if a != "target"]
        return target_star(features) if self.target_only else all_pairs([*features, "target"])

    def noisy(self, tables: Tables, cluster_id: int, noise: Noise) -> tuple[dict[tuple[str, ...], np.ndarray], dict[tuple[str, ...], float]]:
        """(noisy tables of the chosen views, their sigmas)."""
        sets = self.sets()
        size = {s: math.prod(self.attributes[a] for a in s) for s in sets}
        rho = math.inf if infinite(self.epsilon) else zcdp(self.epsilon, self.delta)
        views: Sequence[tuple[str, ...]] = sets
        if not self.target_only:
            star = [s for s in sets if "target" in s]
            views = choose_views(self._scores(tables, 0.1 * rho, cluster_id, noise), size, star, 0.9 * rho, self.view_rounds)
            rho = 0.9 * rho
        sigma = view_sigmas(size, views, rho)
        shape = lambda s: [self.attributes[a] for a in s]
        return {s: noisy_table(tables[i], sigma[s], noise, cluster_id, i).reshape(shape(s)) for i, s in enumerate(sets) if s in sigma}, sigma

    def _scores(self, tables: Tables, rho: float, cluster_id: int, noise: Noise) -> dict[tuple[str, str], float]:
        """Dependency scores of all pairs: one row moves a score by 4 at most, and one more for rounding it to an integer."""
        sets, found = self.sets(), {}
        z = noise.discrete_normals(0.0 if math.isinf(rho) else gauss_sigma(rho / len(sets), 5.0), ("score", cluster_id), range(len(sets)))
        for i, s in enumerate(sets):
            t = tables[i].reshape([self.attributes[a] for a in s]).astype(float)
            found[s] = float(round(np.abs(np.outer(t.sum(axis=1), t.sum(axis=0)) / max(t.sum(), 1.0) - t).sum()) + z[i])
        return found

    def fit(self, tables: Tables, cluster_id: int, noise: Noise):
        found, sigma = self.noisy(tables, cluster_id, noise)
        if not any((m > 0).any() for m in found.values()):
            return None
        return consistent({s: m.astype(float) for s, m in found.items()}, self.consistency_rounds, sigma)

    def draw(self, model, n: int, rng: np.random.Generator) -> np.ndarray:
        return gradual_update(model, self.attributes, n, self.update_rounds, int(rng.integers(1 << 62)))


@dataclass
class GeneratorMethod:
    """The adaptive generator: a mixture whose worst-answered table is measured and fitted, round after round.

    A twentieth of rho buys a noisy number of rows; each round spends alpha of its share on an
    exponential-mechanism choice among the tables and the rest on one measurement. Counts are
    compared, not shares: a row moves a table's L1 error and one of its cells by one, whatever the number of rows.
    """

    attributes: Mapping[str, int]
    epsilon: float
    delta: float = 1e-5
    config: GeneratorConfig = GeneratorConfig()
    seed: int = 0

    COUNT_SHARE = 0.05

    def sets(self) -> list[tuple[str, ...]]:
        features = [a for a in self.attributes if a != "target"]
        workload = target_star(features) if self.config.target_star else all_pairs([*features, "target"], min(self.config.degree, len(features) + 1))
        return [*workload, ()]  # the empty set counts the rows

    def scales(self) -> tuple[float, float, float]:
        """(sigma of the row count, scale of the choice, sigma of a table); they follow from public settings alone."""
        if infinite(self.epsilon):
            return 0.0, 0.0, 0.0
        rho, rounds = zcdp(self.epsilon, self.delta), self.rounds()
        each = (1 - self.COUNT_SHARE) * rho / rounds
        return gauss_sigma(self.COUNT_SHARE * rho), 2.0 / math.sqrt(8 * self.config.alpha * each), gauss_sigma((1 - self.config.alpha) * each)

    def rounds(self) -> int:
        return max(1, min(self.config.rounds, len(self.sets()) - 1))

    def fit(self, tables: Tables, cluster_id: int, noise: Noise):
        sets, c = self.sets(), self.config
        count, choice, table = self.scales()
        last = len(sets) - 1
        n = float(noisy_table(tables[last], count, noise, cluster_id, last)[0])
        if n < 1:
            return None
        shape = [[self.attributes[a] for a in s] for s in sets]
        model, measured = Mixture(self.attributes, c, self.seed + cluster_id), {}
        for r in range(self.rounds()):
            left = [i for i in range(last) if sets[i] not in measured]
            score = [np.abs(n * model.answer(sets[i]).ravel() - tables[i]).sum() for i in left]
            gumbel = [-choice * math.log(-math.log(noise.number("choice", cluster_id, r, i))) for i in left]
            pick = left[int(np.argmax(np.add(score, gumbel)))]
            measured[sets[pick]] = simplex(noisy_table(tables[pick], table, noise, cluster_id, pick).astype(float).reshape(shape[pick]), n) / n
            model.fit(measured, r, self.rounds())
        return model.state()

    def draw(self, model, n: int, rng: np.random.Generator) -> np.ndarray:
        return Mixture.restored(self.attributes, self.config, model).sample(n, rng)


#: Synthetic rows that one task draws at a time; a pool is made of as many blocks as it needs. Models are sent to all tasks up to so many bytes.
BLOCK_ROWS, SENT_BYTES = 20_000, 64 << 20


@dataclass(frozen=True)
class Release:
    """One pool or one pool per cluster: what is made of which rows with which noise. ``number`` tells releases of one sweep apart."""

    number: int
    method: Method
    k: int
    noise: Noise


def release_models(cells: DataFrame, releases: Sequence[Release]) -> dict[tuple[int, int], bytes | None]:
    """(release, cluster) -> model, None where its noisy tables are empty.

    ``cells`` (release, cluster_id, set_id, at, n) hold the dense tables of every cluster of every release. One task fits one cluster.
    """
    made = {r.number: (r.method, r.noise) for r in releases}

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        method, noise = made[int(key[0])]
        tables = {int(i): g["n"].to_numpy() for i, g in pdf.sort_values(["set_id", "at"]).groupby("set_id")}
        model = method.fit(tables, int(key[1]), noise)
        return pd.DataFrame({"release": [key[0]], "cluster_id": [key[1]], "model": [None if model is None else pickle.dumps(model)]})

    rows = cells.select("release", "cluster_id", "set_id", "at", "n").groupBy("release", "cluster_id")
    found = {(r["release"], r["cluster_id"]): r["model"] for r in rows.applyInPandas(fit, "release int, cluster_id int, model binary").collect()}
    return {(r.number, c): None if found[r.number, c] is None else bytes(found[r.number, c]) for r in releases for c in range(r.k)}


def cluster_cells(coded: DataFrame, sets: Sequence[tuple[str, ...]], attributes: Mapping[str, int], releases: Sequence[Release]) -> DataFrame:
    """(release, cluster_id, set_id, at, n): dense tables of every cluster, from one scan of ``coded`` (release, cluster_id, codes)."""
    groups = coded.sparkSession.createDataFrame([(r.number, c) for r in releases for c in range(r.k)], "release int, cluster_id int")
    by = ["release", "cluster_id"]
    return marginal_tables(coded.withColumns({b: F.col(b).cast("int") for b in by}), sets, attributes, by, groups).select(*by, "set_id", "at", "n")


def cluster_models(coded: DataFrame, method: Method, k: int, noise: Noise) -> list[bytes | None]:
    """The model of each cluster 0 to k - 1 of ``coded`` (cluster_id, codes), None where its noisy tables are empty."""
    release = Release(0, method, k, noise)
    found = release_models(cluster_cells(coded.withColumn("release", F.lit(0)), method.sets(), method.attributes, [release]), [release])
    return [found[0, c] for c in range(k)]


def draw_releases(spark: SparkSession, models: Mapping[tuple[int, int], bytes | None], releases: Sequence[Release], rows_each: Mapping[int, int]) -> DataFrame:
    """(release, cluster_id, synth_id, codes): ``rows_each`` rows of every model of a release, block by block."""
    made = {r.number: (r.method, r.noise, rows_each[r.number]) for r in releases}
    names = list(releases[0].method.attributes)
    rows = [(n, c, m, max(1, -(-rows_each[n] // BLOCK_ROWS))) for (n, c), m in models.items() if m is not None]
    known = spark.createDataFrame(rows, "release int, cluster_id int, model binary, blocks int")
    most = max((r[3] for r in rows), default=1)
    blocks = spark.range(0, most, 1, min(most, 4096))
    # a model a cluster, of public size
    dealt = blocks.join(F.broadcast(known) if sum(len(r[2]) for r in rows) <= SENT_BYTES else known, F.col("id") < F.col("blocks"))
    dealt = dealt.select("id", "release", "cluster_id", "model", "blocks")
    kind = "release int, cluster_id int, synth_id long, " + ", ".join(f"`{c}` int" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, release, cluster_id, model, parts in zip(*(c.to_pylist() for c in b.columns)):
                method, noise, n = made[release]
                size = -(-n // parts)
                first, end = block * size, min((block + 1) * size, n)
                if first < end:
                    seed = hashlib.sha256(f"{noise.key}|draw|{cluster_id}|{block}".encode()).digest()
                    codes = method.draw(pickle.loads(model), end - first, np.random.default_rng(int.from_bytes(seed)))
                    whole = lambda v: pa.array(np.full(end - first, v, np.int32))
                    yield pa.record_batch([whole(release), whole(cluster_id), pa.array(np.arange(first, end)), *(pa.array(codes[:, j].astype(np.int32)) for j in range(len(names)))], names=["release", "cluster_id", "synth_id", *names])

    return dealt.mapInArrow(run, kind)


def draw_pools(spark: SparkSession, models: Sequence[bytes | None], method: Method, rows_each: int, noise: Noise) -> DataFrame:
    """(cluster_id, synth_id, codes): ``rows_each`` rows of every model there is."""
    release = Release(0, method, len(models), noise)
    return draw_releases(spark, {(0, c): m for c, m in enumerate(models)}, [release], {0: rows_each}).drop("release")


def _pool(rows: DataFrame, schema: PublicSchema, method: Method, n_synth: int, noise: Noise, bins: int) -> DataFrame:
    """One pool of all ``rows``."""
    models = cluster_models(encode_rows(rows, schema, bins).withColumn("cluster_id", F.lit(0)), method, 1, noise)
    if models[0] is None:
        raise EmptyTables("no noisy cell is positive")
    return validate_pool(decode_rows(draw_pools(rows.sparkSession, models, method, n_synth, noise), schema, bins, ["synth_id"]), schema)


def marginal_synthesize(rows: DataFrame, schema: PublicSchema, epsilon: float, n_synth: int, noise: Noise, bins: int = 8, delta: float = 1e-5, consistency_rounds: int = 2, view_rounds: int = 10, update_rounds: int = 20, target_only: bool = True) -> DataFrame:
    """The marginal method over all rows: see ``MarginalMethod``."""
    method = MarginalMethod(sizes(schema, bins), epsilon, delta, consistency_rounds, view_rounds, update_rounds, target_only)
    return _pool(rows, schema, method, n_synth, noise, bins)


def generator_synthesize(rows: DataFrame, schema: PublicSchema, epsilon: float, n_synth: int, noise: Noise, bins: int = 8, delta: float = 1e-5, config: GeneratorConfig | None = None, seed: int = 0) -> DataFrame:
    """The adaptive generator over all rows: see ``GeneratorMethod``."""
    return _pool(rows, schema, GeneratorMethod(sizes(schema, bins), epsilon, delta, config or GeneratorConfig(), seed), n_synth, noise, bins)


def centroid_fallback(spark: SparkSession, center: Mapping[str, float | str], schema: PublicSchema, n_rows: int, compat: Sequence[float] | None = None) -> DataFrame:
    """One decoded row ``n_rows`` times, targets alternating 0, 1.

    ``compat``: the flat centre (one number per feature, categories by index) read as the
    older convention reads it, each number as a share of its domain.
    """
    row = dict(center)
    if compat is not None:
        for i, c in enumerate(schema.features):
            v = min(max(float(compat[i]), 0.0), 1.0) if i < len(compat) else None
            if c in schema.numeric:
                row[c] = 0.5 if v is None else v
            else:
                d = schema.domain(c)
                row[c] = d[0] if v is None else d[min(max(int(round(v * (len(d) - 1))), 0), len(d) - 1)]
    return spark.range(n_rows).select(F.col("id").alias("synth_id"), *[F.lit(row[c]).alias(c) for c in schema.features], (F.col("id") % 2).cast("int").alias("target"))


def cluster_pools(assigned: DataFrame, schema: PublicSchema, centers: Sequence[Sequence[float]], spec, rows_per_cluster: int, method: Method, noise: Noise, bins: int = 8) -> tuple[DataFrame, list[ClusterLog]]:
    """(pools with cluster_id, log): one pool per centre, the decoded centre where the noisy tables are empty.

    All clusters' tables come from one scan of ``assigned``. Whether a cluster falls back rests on noisy tables alone.
    """
    from .encode import decode_center

    spark = assigned.sparkSession
    models = cluster_models(encode_rows(assigned, schema, bins, keep=["cluster_id"]), method, len(centers), noise)
    pools = decode_rows(draw_pools(spark, models, method, rows_per_cluster, noise), schema, bins, ["cluster_id", "synth_id"])
    log = [ClusterLog(c, m is None, "no noisy cell is positive" if m is None else None) for c, m in enumerate(models)]
    for x in log:
        if x.fallback:
            own = centroid_fallback(spark, decode_center(spec, centers[x.cluster_id]), schema, rows_per_cluster)
            pools = pools.unionByName(own.withColumn("cluster_id", F.lit(x.cluster_id)))
    return validate_pool(pools, schema), log


def fallback_count(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.sum(F.col("fallback").cast("int")), F.lit(0)).cast("long").alias("fallback_clusters"))

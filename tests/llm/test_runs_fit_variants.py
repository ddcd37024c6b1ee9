"""Periodic runs, best-fit packing and spelling variants against brute force, and their edge rows."""

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import DOCS, EDGES, docs
from tokenizers import Tokenizer

from veilspark.llm import bestfit, periodic, queries, variants
from veilspark.llm.queries import tokenizer_path


def brute_runs(w, min_words=6, times=4):
    """All runs by the definition: every stretch of every period, its smallest period by trial."""
    n, out = len(w), set()
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            start, end = i, j + q
            if j > i and end - start >= max(min_words, times * q):
                part = w[start:end]
                if not any(all(part[k] == part[k + d] for k in range(len(part) - d)) for d in range(1, q)):
                    out.add((start, end - start, q))
            i = j + 1
    return sorted(out)


def brute_collapsed(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), max_size=4), st.integers(0, 12), st.integers(1, 5))
def test_runs_are_brute_force(texts, times, q):
    texts = texts + [(t[:q] or ["z"]) * times + t[q:] for t in texts]
    found = list(periodic.batch_runs([" ".join(t).encode() for t in texts]))
    for t, (runs, collapsed) in zip(texts, found):
        assert runs == brute_runs(t)
        assert collapsed.decode().split() == brute_collapsed(t, runs)


def test_heavy_words_count_like_light_ones():
    rng = np.random.default_rng(1)
    sizes = np.array([900, 0, 1, 700, 5])
    codes = rng.integers(0, 4, sizes.sum())  # each of the four words is frequent in the long texts
    ends = np.cumsum(sizes)
    for n, end, counts in zip(sizes, ends, periodic.lag_counts(codes, sizes)):
        c = codes[end - n : end]
        assert counts.tolist() == [0] + [int((c[q:] == c[:-q]).sum()) for q in range(1, n // 4 + 1)]


def test_periodic_texts_are_scanned_few_times(monkeypatch):
    scans = []
    real = periodic._islands
    monkeypatch.setattr(periodic, "_islands", lambda c, q, need: scans.append(q) or real(c, q, need))
    runs, collapsed = next(periodic.batch_runs([b"x " * 50_000]))
    assert runs == [(0, 50_000, 1)] and collapsed == b"x" and scans == [1]
    line = [f"w{i}" for i in range(9)]
    runs, _ = next(periodic.batch_runs([" ".join(["a"] + line * 3000 + ["b"]).encode()]))
    assert runs == [(1, 27_000, 9)] and scans == [1, 9]


def test_long_lags():
    rng = np.random.default_rng(2)
    line = [str(x) for x in rng.integers(0, 300, 1100)]
    w = ["q"] * 7 + line * 5 + line[:60] + ["end"] * 8
    runs, collapsed = next(periodic.batch_runs([" ".join(w).encode()]))
    assert (7, 5 * 1100 + 60, 1100) in runs and (0, 7, 1) in runs and (len(w) - 8, 8, 1) in runs
    assert collapsed.decode().split() == brute_collapsed(w, runs)


def test_runs_of_edge_rows(spark):
    rows = [*EDGES, (20, "go " * 6, "a"), (21, "\v a b\fa b\r\na b a b ", "a"), (21, "é é é é é é", "a"), (22, "x\x85x x\x85x x\x85x", None)]
    out = periodic.periodic_runs(docs(spark, rows)).collect()
    assert len(out) == len(rows) and {r.id for r in out} == {i for i, _, _ in rows}
    got = Counter((r.id, tuple(map(tuple, r.runs)), r.collapsed) for r in out)
    want = Counter()
    for i, t, _ in rows:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]
        runs = brute_runs(w) if len(w) < 100 else [(0, 30_000, 4001)]  # the long texts go round 4001 words
        want[i, tuple(runs), " ".join(brute_collapsed(w, runs))] += 1
    assert got == want
    assert periodic.periodic_runs(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs(spark, []), times=1)


def test_runs_with_other_bounds():
    w = "a b a b a b c c c".split()
    assert next(periodic.batch_runs([" ".join(w).encode()], 3, 3))[0] == brute_runs(w, 3, 3) == [(0, 6, 2), (6, 3, 1)]


def test_op11_repeats_as_told(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(map(str, rng.integers(0, 50, int(rng.integers(0, 90))))), "a") for i in range(120)] + [(None, "a b c", "a"), (121, None, None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, t, _ in rows:
        w, h = (t or "").split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else x for k, x in enumerate(w)]
            planted += 1
        runs = brute_runs(w)
        sha = lambda s: __import__("hashlib").sha256(s.encode()).hexdigest()
        assert out[i].n_runs == len(runs) and out[i].runs_sha256 == sha("".join("%d,%d,%d\n" % r for r in runs))
        assert out[i].collapsed_sha256 == sha(" ".join(brute_collapsed(w, runs)))
        top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        assert (out[i].start, out[i].length, out[i].period) == (top or (None,) * 3) and out[i].exponent_milli == (top and 1000 * top[1] // top[2])
    assert planted > 5


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(0, 9), max_size=24))
def test_plan_places_all_and_overlaps_nothing(counts):
    steps = bestfit.plan(counts, 24)
    seen, used = Counter(), Counter()
    for size, rank, n, each, first, offset in sorted(steps, key=lambda s: s[5]):
        assert rank == sum(s[2] for s in steps if s[0] == size and s[1] < rank) and n > 0
        for j in range(n):
            w = first + j // each
            assert used[w] == offset + j % each * size  # gapless
            used[w] += size
            seen[size] += 1
    assert seen == Counter({k: v for k, v in counts.items() if v}) and max(used.values(), default=0) <= 24
    assert sorted(used) == list(range(len(used)))
    total = sum(k * v for k, v in counts.items())
    assert len(used) <= 11 / 9 * best_bound(counts, 24) + 1 and len(used) >= -(-total // 24)


def best_bound(counts, window):
    """No packing has fewer windows: by tokens, and by the pieces over half and (in pairs) over a third."""
    total = sum(k * v for k, v in counts.items())
    half = sum(v for k, v in counts.items() if 2 * k > window)
    third = sum(v for k, v in counts.items() if 3 * k > window)
    return max(-(-total // window), half, -(-third // 2))


def test_matching_is_as_large_as_any():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(9, 24, int(rng.integers(1, 9))).tolist()  # all over a third of 24

        def most(rest):
            return max([0] + [1 + most(rest[:i] + rest[i + 1 : j] + rest[j + 1 :]) for i, j in combinations(range(len(rest)), 2) if rest[i] + rest[j] <= 24])

        steps = bestfit.plan(Counter(sizes), 24)
        assert max(s[4] + -(-s[2] // s[3]) for s in steps) == len(sizes) - most(sizes)


def test_plan_is_short_however_many_pieces():
    rng = np.random.default_rng(4)
    counts = {int(s): int(n) for s, n in zip(range(1, 2049), rng.integers(1, 10**9, 2048))}
    steps = bestfit.plan(counts)
    windows = max(first + -(-n // each) for _, _, n, each, first, _ in steps)
    assert len(steps) < 40_000 and windows <= best_bound(counts, 2048) * 1.005 + 1  # no packing has fewer than the bound; not every bound can be reached


def test_plan_refuses_lengths_beyond_the_window():
    with pytest.raises(ValueError):
        bestfit.plan({2049: 1})


def test_bestfit_is_an_exact_round_trip(spark):
    rng = np.random.default_rng(6)
    rows = EDGES + [(100 + i, " ".join(rng.choice(["the", "Éon", "x9", "don't"], int(rng.integers(0, 1500)))), "a") for i in range(60)] + [(300, "same text", "b")] * 40
    out = bestfit.pack_whole(docs(spark, rows).repartition(5), tokenizer_path()).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t, _ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    windows = {}
    for r in out:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(windows) <= best_bound(Counter(r.length for r in out), 2048) * 1.01 + 1
    assert bestfit.pack_whole(docs(spark, []), tokenizer_path()).count() == 0


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=5):
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé𝄞", min_size=1, max_size=6), unique=True, max_size=12))
def test_keys_meet_for_near_words_only(words):
    of, key, low, high = variants.deletion_keys(words) if words else (np.empty(0, int),) * 4
    met = Counter()
    for i in range(len(of)):
        for j in range(len(of)):
            if of[i] < of[j] and key[i] == key[j] and low[i] < high[j] and low[j] < high[i]:
                met[words[of[i]], words[of[j]]] += 1
    assert met == Counter((a, b) for a, b in combinations(words, 2) if one_edit(a, b))


def test_variants_are_brute_force(spark):
    rng = np.random.default_rng(7)
    stems = ["".join(rng.choice(list("abcdéü"), int(rng.integers(4, 9)))) for _ in range(40)]
    counts = Counter()
    for s in stems:
        counts[s] += int(rng.integers(1, 900))
        for _ in range(6):  # misspellings of misspellings
            i = int(rng.integers(0, len(s)))
            s = s[:i] + rng.choice(["", "x", s[i] + "y"]) + s[i + 1 :]
            counts[s] += int(rng.integers(1, 40))
    counts |= {"L" * 3000: 40, "L" * 2999: 6, "L" * 1500 + "M" + "L" * 1499: 5, "abcdefg": 700, "abcdefgh": 140, "abcdefghi": 28, "abcdefghij": 5, "abcdef": 3500, "zabcdef": 3500}
    table = spark.createDataFrame([(w, n) for w, n in counts.items()] + [(None, 50)], "word string, n int").select("word", F.explode(F.sequence(F.lit(1), "n")).alias("n"), F.lit(1).alias("wid"))
    want = brute_variants({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(table).collect()}
    assert got == want and got["abcdefghij"][1] == "abcdef" and got["L" * 2999][0] == "L" * 3000
    assert variants.group_variants(table.limit(0)).count() == 0


def test_op13_reads_runs_as_told(spark, tmp_path):
    import re

    rng = np.random.default_rng(8)
    stock = ["Straße", "ÉTÉNARD", "éténard", "planet", "Planets", "short", "Zeitung", "zeitunge", "x÷y×zab"]
    rows = [(i, ", ".join(rng.choice(stock, int(rng.integers(0, 60)))), "a") for i in range(150)] + [(None, "planet planet", "a"), (200, None, None), (201, "", "a")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    counts, cut = Counter(), 0
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else zlib.crc32(run.encode())
            if h % 199 == 0:
                run, cut = run[: h % len(run)] + run[h % len(run) + 1 :], cut + 1
            counts[run] += len(run) >= 6
    want = brute_variants({w: n for w, n in counts.items() if n >= 5})
    assert cut > 10 and {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op13_variants(spark, str(tmp_path)).collect()} == want


def test_schemas_keep_clashing_names_out(spark):
    extra = docs(spark, [(1, "a b", "s")]).withColumnRenamed("key", "piece").withColumnRenamed("norm", "runs").withColumnRenamed("u", "length")
    assert periodic.periodic_runs(extra).count() == 1 and bestfit.pack_whole(extra, tokenizer_path()).count() == 1
    assert len(DOCS) == len(extra.columns)

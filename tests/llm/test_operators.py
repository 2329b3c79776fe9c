"""The operators on small tables with nulls, empty and repeated rows, ties and clashing columns."""

import base64
import collections
import heapq
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from weft.llm import byte_bpe, hamming_search, jaccard_join, katz, language, mixing, pseudonyms, sharding, toxicity, vector_dedup
from weft.llm.common import held_out
from weft.llm.graph import components
from weft.llm.running import running_total

RNG = np.random.default_rng(3)
WORDS = [f"w{k}" for k in range(60)]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, lang string, id string, node string, n long, word string"


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def sample_texts():
    base = prose(80)
    texts = [prose(int(RNG.integers(1, 60))) for _ in range(30)]
    texts += [base, base.upper(), base.replace(" ", "\n"), base + " tail", "head " + base, None, "", " \t ", "one", "One", "long " * 3000]
    return texts + ["ünï çödé " + base, texts[0], "\x00 nul \x00", "emoji 👩‍👩‍👧 🇩🇪 end"]


TEXTS = sample_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "ab"[k % 2] if k % 7 else None, "en", "x", "y", 1, "z") for k, t in enumerate(TEXTS)]
    rows.append(rows[0])  # a repeated row
    rows.append((None, "a row without an id", "a", None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 3), (5, 6), (6, 5), (7, 7), (None, 4)] + [(k, k + 1) for k in range(100, 160)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {k: 100 for k in range(100, 161)}


def test_hamming_search(spark):
    vectors = [(k, RNG.choice([-1.0, 1.0], 64).tolist()) for k in range(300)]
    vectors += [(300 + k, vectors[k % 5][1]) for k in range(60)] + [(500, None), (501, [float("nan")] * 64), (None, vectors[0][1])]
    vectors += [vectors[0]]
    codes = hamming_search.sign_codes(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    rows = {r["id"]: r["code"] % 2**64 for r in codes.collect()}
    assert len(rows) == 360
    got = collections.defaultdict(list)
    for r in hamming_search.search_codes(codes, codes.filter("id % 20 = 0"), 7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["vec_id"]))
    for q in [i for i in rows if i % 20 == 0]:
        assert got[q] == sorted(((rows[q] ^ c).bit_count(), i) for i, c in rows.items() if i != q)[:7]
    few = codes.filter("id < 3")
    assert hamming_search.search_codes(few, few, 7).count() == 6
    assert hamming_search.search_codes(codes.limit(0), codes.limit(0), 7).count() == 0


def test_hamming_search_of_ids_with_several_codes(spark):
    """The k nearest other ids, each once at its least distance, whatever the number of its codes."""
    rows = [(int(k % 40), int(c)) for k, c in enumerate(RNG.integers(0, 1 << 12, 200))] + [(0, 5), (0, 5), (None, 7)]
    index = spark.createDataFrame(rows, "id long, code long")
    got = collections.defaultdict(list)
    for r in hamming_search.search_codes(index, index.filter("id % 20 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["vec_id"]))
    for q in (0, 20):
        mine = [c for k, c in rows if k == q]
        least = {}
        for k, c in rows:
            if k not in (q, None):
                least[k] = min([least.get(k, 64), *[bin(c ^ m).count("1") for m in mine]])
        assert got[q] == sorted((d, k) for k, d in least.items())[:10]


def test_hamming_search_of_a_hot_block(spark, monkeypatch):
    for name, most in (("BLOCK_MOST", 64), ("BLOCK_CODES", 32), ("CANDIDATES", 50)):
        monkeypatch.setattr(hamming_search, name, most)
    base = int(RNG.integers(1 << 40, 1 << 62))
    rows = {k: base ^ int(RNG.integers(1 << 20)) for k in range(300)} | {300 + k: int(RNG.integers(1 << 62)) for k in range(100)}
    codes = spark.createDataFrame(list(rows.items()), "id long, code long")
    got = collections.defaultdict(list)
    for r in hamming_search.search_codes(codes, codes.filter("id % 5 = 0"), 7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["vec_id"]))
    for q in [i for i in rows if i % 5 == 0]:
        assert got[q] == sorted(((rows[q] ^ c).bit_count(), i) for i, c in rows.items() if i != q)[:7]


def test_hamming_task_holds_no_bucket_product():
    import tracemalloc

    import pyarrow as pa

    n, asked = 20_000, 400
    codes = RNG.choice(1 << 40, n, replace=False) << 16  # one value of the lowest segment
    left = pa.table({"code": codes, "first": np.arange(n), "n": np.ones(n, np.int64)})
    right = pa.table({"block": np.zeros(asked, np.int64), "q": codes[:asked], "bound": np.full(asked, 64)})
    tracemalloc.start()
    got = hamming_search._search([(0, 16), (16, 16), (32, 16), (48, 16)], 1, 0, 8)(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == asked * 8 and peak < 16 * n * asked
    for q, hits in itertools.groupby(sorted(zip(*(got[c].to_pylist() for c in ("q", "distance", "first")))), lambda r: r[0]):
        assert [h[1:] for h in hits] == sorted(((int(c) ^ q).bit_count(), k) for k, c in enumerate(codes.tolist()))[:8]


def test_toxicity(spark, docs, none):
    clean = [(k, prose(30), 0) for k in range(80)]
    bad = [(100 + k, prose(20) + " nastyword " + prose(5), 1) for k in range(40)]
    table = spark.createDataFrame(clean + bad, "doc_id long, text string, toxic int")
    model = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    new = [(1, prose(40), 0), (2, prose(40) + " nastyword", 1), (3, None, 0), (4, "", 0)]
    got = toxicity.score(spark.createDataFrame(new, "doc_id long, text string, score int"), model).collect()
    assert {r["doc_id"]: r["predicted"] for r in got} == {i: y for i, _, y in new}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    untaught = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, untaught).collect()} == {0.5}
    assert toxicity.score(none, model).count() == 0


def katz_scores(seqs, trained):
    uni, bi, heads = collections.Counter(), collections.Counter(), collections.Counter()
    for k in trained:
        before = "<s>"
        for w in seqs[k]:
            uni[w] += 1
            bi[before, w] += 1
            heads[before] += 1
            before = w
    def rates(counts):
        return katz.discounts(np.array([0] + [sum(v == r for v in counts.values()) for r in range(1, katz.MOST + 2)]))
    d1, d2 = rates(uni), rates(bi)
    cut = lambda d, c: d[c] if c <= katz.MOST else 1.0
    n = sum(uni.values())
    extra = 0 if any(c <= katz.MOST for c in uni.values()) else 1
    one = {w: cut(d1, c) * c / (n + extra) for w, c in uni.items()}
    rest, nexts, weight, more = 1 - sum(one.values()), collections.defaultdict(list), {}, {}
    for (h, w), c in bi.items():
        nexts[h].append((w, c))
    for h, found in nexts.items():
        more[h] = 0 if any(c <= katz.MOST for _, c in found) else 1
        weight[h] = (1 - sum(cut(d2, c) * c for _, c in found) / (heads[h] + more[h])) / (1 - sum(one[w] for w, _ in found))
        total = sum(cut(d2, c) * c / (heads[h] + more[h]) for _, c in found)
        total += weight[h] * (1 - sum(one[w] for w, _ in found))
        assert abs(total - 1) < 1e-9  # normalised over all words and the unknown class
    out = []
    for seq in seqs:
        before, score = "<s>", 0.0
        for w in seq:
            c = bi.get((before, w), 0)
            score += math.log10(cut(d2, c) * c / (heads[before] + more[before]) if c else weight.get(before, 1) * one.get(w, rest))
            before = w
        out.append(score)
    return out, uni, n


@pytest.mark.parametrize("hot", [10**6, 25, 3])
def test_katz(spark, docs, none, hot):
    rows = docs.select("doc_id", "text").collect()
    seqs = [words(r["text"]) + [None] for r in rows]
    trained = [k for k, r in enumerate(rows) if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3]
    want, uni, n = katz_scores(seqs, trained)
    got = katz.score(docs, held_out(F.col("doc_id"), 3), hot_least=hot).collect()
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {n}
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    for r, k in zip(sorted(got, key=key), sorted(range(len(rows)), key=lambda k: key(rows[k]))):
        assert r["n_tokens"] == len(seqs[k]) and r["n_known"] == sum(w in uni for w in seqs[k])
        assert r["score"] == pytest.approx(want[k], abs=1e-6)
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (len(uni) + 1))) for w in seqs[k])
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
    assert katz.score(none, F.lit(False)).count() == 0
    assert {r["score"] for r in katz.score(docs, F.lit(True)).collect()} == {0.0}


def groups(sets, linked):
    least = {i: i for i in sets}
    def root(i):
        while least[i] != i:
            i = least[i]
        return i
    for a, b in itertools.combinations(sorted(sets), 2):
        if linked(sets[a], sets[b]):
            x, y = sorted((root(a), root(b)))
            least[y] = x
    return {i: root(i) for i in sets}


def test_jaccard_join(spark, docs, none):
    base = [f"u{k}" for k in range(100)]
    near = [(1000 + k, " ".join(base[:k] + ["x%d" % k] + base[k + 1 :])) for k in range(0, 100, 4)]
    more = spark.createDataFrame(near, "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    sets = {}
    for r in both.filter("doc_id is not null").collect():
        w = words(r["text"])
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    want = groups(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b))
    got = jaccard_join.near_duplicates(both).collect()
    assert len(got) == both.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    kept = jaccard_join.without_copies(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.filter("doc_id is not null").collect()]
    assert sorted(ids) == sorted(i for i in set(ids) if want[i] == i) and len(ids) == sum(want[i] == i for i in want if i < 1000)
    assert jaccard_join.near_duplicates(none).count() == 0


def test_choose_matches():
    assert jaccard_join.choose_matches(np.array([1.0, 1, 1, 1, 1]), 3, 3) in (1, 2, 3)
    assert jaccard_join.choose_matches(np.array([50.0, 50, 1, 1]), 2, 3) == 3
    assert jaccard_join.choose_matches(np.array([1.0, 1, 10**6]), 2, 2) == 1


def test_vector_dedup(spark):
    base = RNG.normal(size=(40, 24))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, (base[k % 8] + RNG.normal(size=24) * 0.12).tolist()) for k in range(80)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, [0.0] * 24), (303, None), (304, [float("inf")] * 24), (305, [1.0]), (306, [])]
    table = spark.createDataFrame(rows + [(None, rows[1][1])], "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    valid = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and len(v) == 24 and np.isfinite(v).all() and any(v)}
    want = {**{i: i for i, _ in rows}, **groups(valid, lambda a, b: a @ b >= 0.95)}
    for r in vector_dedup.near_duplicates(table).collect():
        i = r["vec_id"]
        if i is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
            continue
        n = sum(valid[i] @ v >= 0.95 for j, v in valid.items() if j != i) if i in valid else 0
        assert (r["n_links"], r["component_id"], r["kept"]) == (n, want[i], want[i] == i)
    assert vector_dedup.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [2, 4096])
def test_vector_dedup_tiles_lengths_and_shared_ids(spark, monkeypatch, tile):
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    monkeypatch.setattr(vector_dedup, "TILE_BYTES", 64 * tile)
    near = RNG.normal(size=(4, 16))
    rows = [(k, (near[k % 4] + RNG.normal(size=16) * 0.15).tolist()) for k in range(60)]
    short = RNG.normal(size=10)
    rows += [(100 + k, (short + RNG.normal(size=10) * 0.05).tolist()) for k in range(5)]
    # Ids 0 and 1 also stand for a vector that links with nothing and for a near copy of their own.
    rows += [(0, (-near[0] + near[1] * 3).tolist()), (1, (np.array(rows[1][1]) * 1.01 + 0.001).tolist())]
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    linked = lambda a, b: len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if linked(a, b) and group[a] != group[b]:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    want = [(i, sum(linked(k, o) for o in range(len(rows)) if o != k), min(rows[o][0] for o in range(len(rows)) if group[o] == group[k])) for k, (i, _) in enumerate(rows)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_dedup.near_duplicates(table).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(want)
    assert sum(r["kept"] for r in got) == len(set(group))


def test_vector_dedup_task_holds_no_pairs():
    import tracemalloc

    import pyarrow as pa

    n, plan = 3000, vector_dedup.Plan(8, 3000, 0.95)
    y = vector_dedup.rotated(np.ones((n, 8)) + RNG.normal(size=(n, 8)) * 0.01)
    table = pa.table({
        "dims": pa.array([8] * n, pa.int32()), "block": pa.array([0] * n, pa.int32()), "left": pa.array([0] * n, pa.int32()),
        "right": pa.array([0] * n, pa.int32()), "home": pa.array([0] * n, pa.int32()), "node": np.arange(n), "w": np.ones(n, np.int64),
        "y": pa.array(y.tolist(), pa.list_(pa.float64())),
    })
    tracemalloc.start()
    got = vector_dedup._join({8: plan}, 0.95)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(got["links"].to_pylist()) == {n - 1} and set(got["with"].to_pylist()) == {0}
    assert peak < 16 * n * n  # bytes; the pairs alone would be 8 * n * n, and as much again when joined


def test_mixing(spark, docs, none):
    big = spark.createDataFrame([(k, prose(300), f"s{k % 3}") for k in range(60)], "doc_id long, text string, source string")
    made = mixing.mix(big, block_words=16).taken().collect()
    again = mixing.mix(big, block_words=16).taken().collect()
    assert sorted(made) == sorted(again) and len(made) == 60
    assert all(r["taken"] <= 2 * r["size"] for r in made)
    for source in ("s0", "s1", "s2"):
        mine = [r for r in made if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 16
    goal = {r["source"]: r["target"] for r in made}
    assert goal["s0"] == 12_000 and goal["s2"] == pytest.approx(2 * goal["s1"])
    texts = {r["doc_id"]: r["text"] for r in big.collect()}
    copies = mixing.mixed_documents(big, block_words=16).collect()
    taken = collections.Counter()
    for r in copies:
        taken[r["doc_id"]] += len(words(r["text"]))
        assert set(r["text"].split()) <= set(texts[r["doc_id"]].split())
    assert taken == collections.Counter({r["id"]: r["taken"] for r in made if r["taken"]})
    assert mixing.mix(docs).taken().count() == docs.count()
    assert mixing.mixed_documents(docs, chars_col="n").columns == docs.columns
    assert mixing.mix(none).taken().count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mixed_documents_of_repeated_rows(spark):
    """Equal rows are documents of their own: every text taken is a run of whole words in order."""
    rows = [(1, " ".join(f"w{k}" for k in range(200)), "a", 0)] * 3 + [(1, " ".join(f"w{k}" for k in range(200)), "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    taken = mixing.mix(docs).taken().agg(F.sum("taken")).first()[0]
    texts = [r["text"].split() for r in mixing.mixed_documents(docs, chars_col="n").collect()]
    assert sum(len(t) for t in texts) == taken > 0
    for t in texts:
        numbers = [int(w[1:]) for w in t]
        assert numbers == sorted(set(numbers))


def test_permutations_are_whole():
    for n in (1, 2, 7, 64, 1000):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 5))
        assert sorted(got.tolist()) == list(range(n))


def test_sharding(spark, docs, none):
    got = sharding.shard_documents(docs, 3).collect()
    by_text = collections.defaultdict(set)
    text_of = {k: t for k, t in enumerate(TEXTS)}
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        if r["doc_id"] is not None:
            t = text_of[r["doc_id"]]
            by_text[t].add(r["shard"])
            assert r["size"] == 8 + len((t or "").encode())
            assert r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    even = spark.createDataFrame([(k, f"{k:08d}") for k in range(300)], "doc_id long, text string")
    loads = collections.Counter(r["shard"] for r in sharding.shard_documents(even, 6).collect())
    assert sorted(loads.values()) == [50] * 6
    assert sharding.shard_documents(none, 3).count() == 0


def plain_lpt(runs, shards):
    """Shard of each (size, place), one group at a time."""
    heap, out = [(0, s) for s in range(shards)], {}
    for size, count in sorted(runs, reverse=True):
        for place in range(count):
            load, shard = heapq.heappop(heap)
            out[size, place] = shard
            heapq.heappush(heap, (load + size, shard))
    return out


def test_turns_equal_plain_scheduling():
    for _ in range(400):
        shards = int(RNG.integers(1, 8))
        most = int(RNG.choice([6, 12, 400]))
        runs = {int(RNG.integers(0, most)): int(RNG.choice([1, 2, 3, RNG.integers(1, 70)])) for _ in range(9)}
        turns = sharding.longest_first(list(runs.items()), shards)
        for (size, place), shard in plain_lpt(runs.items(), shards).items():
            first, order = [t for t in turns[size] if t[0] <= place][-1]
            assert order[(place - first) % len(order)] == shard
        assert all(len(t) <= shards for t in turns.values())


@pytest.mark.parametrize("most", [50_000, 0])
def test_sharding_equals_plain_scheduling(spark, monkeypatch, most):
    """Loads and counts of every size per shard are those of scheduling all groups one by one, with both joins."""
    monkeypatch.setattr(sharding, "SIZES_BROADCAST", most)
    texts = [f"{k}".ljust(int(n)) for k, n in enumerate(RNG.integers(5, 90, 500))] + ["copied"] * 400 + ["long " * 500]
    made = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 6).collect()
    sizes = collections.Counter()
    for t, n in collections.Counter(texts).items():
        sizes[n * (8 + len(t))] += 1
    want, got = collections.Counter(), collections.Counter()
    for (size, _), shard in plain_lpt(sizes.items(), 6).items():
        want[shard] += size
    groups = {(texts[r["doc_id"]], r["shard"]) for r in made}
    assert len(groups) == len(set(texts))
    for r in made:
        got[r["shard"]] += r["size"]
    assert got == want


def test_pseudonyms(spark, docs, none):
    texts = [
        "4111 1111 1111 1111 and 4111111111111111, not 4111111111111112", "born 1990-02-28, 28.02.1990, 02/28/1990; no 1990-02-30",
        "+1 (456) 555-2186 or 456-555-2186", "at 10.0.0.255 not 10.0.0.256", "mail A.b+c@ex-a.co.uk.", "password=hunter2x; AKIA" + "A1" * 8, None, "",
        "123-45-6789 000-45-6789", "v" * 50_000 + " 7.5 " + "@" * 2000,
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_card", F.lit("x"))
    rows = {r["doc_id"]: r for r in pseudonyms.pseudonymise(table, "key").collect()}
    digits = lambda s: re.sub(r"\D", "", s)
    first, second = rows[0]["text"][:19], rows[0]["text"][24:40]
    assert digits(first) == second != digits(texts[0][:19]) and rows[0]["text"].endswith(texts[0][-21:])
    total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(second)))
    assert total % 10 == 0 and rows[0]["n_card"] == 2
    iso, german, american = re.findall(r"[\d./-]{10}", rows[1]["text"])[:3]
    assert iso == f"{german[6:]}-{german[3:5]}-{german[:2]}" == f"{american[6:]}-{american[:2]}-{american[3:5]}" != "1990-02-28"
    assert rows[1]["text"].endswith("no 1990-02-30") and rows[1]["n_date"] == 3
    assert digits(rows[2]["text"][3:17]) == digits(rows[2]["text"][21:]) != "4565552186"
    assert "10.0.0.255" not in rows[3]["text"] and "10.0.0.256" in rows[3]["text"]
    assert re.fullmatch(r"mail [a-p]{12}@[a-p]{8}\.example\.", rows[4]["text"])
    assert "hunter2x" not in rows[5]["text"] and "A1A1" not in rows[5]["text"] and rows[5]["n_secret"] == 2
    assert rows[6]["text"] is None and rows[7]["text"] == "" and rows[9]["text"] == texts[9]
    assert rows[8]["n_social"] == 1 and rows[8]["text"].endswith("000-45-6789")
    assert pseudonyms.pseudonymise(docs, "key").count() == docs.count()
    assert pseudonyms.pseudonymise(none, "key").count() == 0


def test_pseudonyms_beside_other_characters(spark):
    one, amex, old = "4111 1111 1111 1111", "3782 822463 10005", "4222222222222"
    bare = one.replace(" ", "")
    texts = {
        f"{one} 123": (bare, 1), f"{bare} 12/27": (bare, 1), f"7 {bare}": (bare, 1), f"{bare} {bare}": (bare, 2), f"1234 {one} 99": (bare, 1),
        f"{amex} 4567": (amex.replace(" ", ""), 1), f"9 {old} 7": (old, 1), f"{one} 5th": (bare, 1), "1234 5678 9012 3456 7": (None, 0),
        "5 " * 5_000 + bare: (bare, 1),
    }
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = {}
    for r in pseudonyms.pseudonymise(table, "key").collect():
        old_text = list(texts)[r["doc_id"]]
        value, n = texts[old_text]
        assert r["n_card"] == r["n_private"] == n and re.sub(r"\d", "0", r["text"]) == re.sub(r"\d", "0", old_text)
        if value is None:
            assert r["text"] == old_text
            continue
        digits, now = re.sub(r"\D", "", old_text), re.sub(r"\D", "", r["text"])
        at = digits.index(value)
        assert now[:at] == digits[:at] and now[at + n * len(value) :] == digits[at + n * len(value) :]
        new.setdefault(value, set()).add(now[at : at + len(value)])
    assert all(len(found) == 1 and value not in found for value, found in new.items())
    others = {
        "(743-555-3824)": "phone", "(+1-743-555-3824)": "phone", "call (743) 555-3824.": "phone", f"{bare} 743-555-3824": "phone",
        "123 743-555-3824": "phone", "2024-01-31T10:00:00Z": "date", "on 1/2/2024": "date", "12345 2024-01-31": "date", "am 3.12.1999": "date",
    }
    table = spark.createDataFrame(list(enumerate(others)), "doc_id long, text string")
    for r in pseudonyms.pseudonymise(table, "key").collect():
        text = list(others)[r["doc_id"]]
        assert r["n_" + others[text]] == 1 and r["text"] != text and r["n_private"] == (2 if bare in text else 1), (text, r)
        assert not re.search(r"743.{1,2}555|2024|1999", r["text"]), (text, r["text"])


def test_feistel_permutes(spark):
    value = pseudonyms.feistel(F.col("id"), F.lit(9).cast("long"), F.lit(11).cast("long"), "k", "t")
    got = [r[0] for r in spark.range(99).select(value).collect()]
    assert sorted(got) == list(range(99)) and got != list(range(99))


def test_language(spark, docs, none):
    french = ["les maisons et leurs jardins sont tranquilles", "nous avons une petite chose pour elle"]
    english = ["the houses and their gardens are quiet", "we have a little thing for her"]
    rows = [(k, t, lang) for k, (t, lang) in enumerate([(t, "fr") for t in french * 5] + [(t, "en") for t in english * 5])]
    learned = spark.createDataFrame(rows + [(90, None, "fr"), (91, "text", None)], "doc_id long, text string, lang string")
    model = language.fit(learned, public_tokenizers.path("piece_bpe_32k.model"))
    assert np.allclose(model.chance.sum(axis=0), 1)
    new = [(1, "The garden has houses", "en"), (2, "une maison pour nous", "fr"), (3, None, "und"), (4, "12 !!", "und"), (5, "", "und"), (6, "x" * 5000, None)]
    got = language.predict(spark.createDataFrame(new, "doc_id long, text string, score string"), model).collect()
    for r in got:
        want = {i: x for i, _, x in new}[r["doc_id"]]
        assert want is None or r["lang_pred"] == want
        assert 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(none, public_tokenizers.path("piece_bpe_32k.model"))).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    hashes = np.sort(np.array([language.piece_hash(p) for p in ("▁", "a", "b", "ab", "▁a")], np.uint64))
    chance = np.linspace(0.1, 0.3, 5)[:, None]
    p = {x: chance[np.searchsorted(hashes, np.uint64(language.piece_hash(x))), 0] for x in ("▁", "a", "b", "ab", "▁a")}
    word = np.array([[ord(c) for c in "▁ab"]], np.uint64)
    lattice = language.Lattice(hashes)
    got = lattice.forward(word, lattice.pieces(word), language._with_floor(chance))[-1, 0, 0]
    assert got == pytest.approx(p["▁"] * p["a"] * p["b"] + p["▁"] * p["ab"] + p["▁a"] * p["b"])


def test_byte_bpe(spark, docs, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    for r in coded.filter("doc_id is not null").collect():
        text = TEXTS[r["doc_id"]] or ""
        assert r["ids"] == peer.encode_ordinary(text)
        for start, end, i in zip(r["starts"], r["ends"], r["ids"]):
            assert peer.decode_single_token_bytes(i) in text[start:end].encode()
    back = byte_bpe.decode(coded, RANKS, public_tokenizers.PATTERN)
    for r in back.filter("doc_id is not null").collect():
        assert r["text"] == (TEXTS[r["doc_id"]] or "") and bytes(r["decoded"]).decode() == r["text"]
    family = peer.encode_ordinary("👩")[:1]
    half = byte_bpe.decode(spark.createDataFrame([(1, family), (2, None)], "doc_id long, ids array<int>"), RANKS, public_tokenizers.PATTERN).collect()
    assert "�" in half[0]["text"] and bytes(half[0]["decoded"]) == peer.decode_single_token_bytes(family[0]) and half[1]["text"] == ""
    digests = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    assert digests.count() == docs.count() and byte_bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_forward_sums_pieces_of_any_length():
    """Against all segmentations, with the longest pieces of the vocabulary among them."""
    hashes, longest = language.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert longest == 16
    chance = (1 + np.arange(len(hashes)) % 97)[:, None] / 100.0
    padded = language._with_floor(chance)
    lattice = language.Lattice(hashes, longest)

    def of(piece):
        at = np.searchsorted(hashes, np.uint64(language.piece_hash(piece)))
        if at < len(hashes) and hashes[at] == np.uint64(language.piece_hash(piece)):
            return padded[at, 0]
        return padded[-1, 0] if len(piece) == 1 else 0.0

    for word in ("▁international", "▁professionally", "▁responsibilities"):
        ways = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            ways[j] = sum(ways[i] * of(word[i:j]) for i in range(j))
        matrix = np.array([[ord(c) for c in word]], np.uint64)
        assert lattice.forward(matrix, lattice.pieces(matrix), padded)[-1, 0, 0] == pytest.approx(ways[-1])
    assert any(of(w) > 0 for w in ("▁international", "▁professional"))


def test_vectors_of_extreme_lengths(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1e200, 2e200]), (3, [1.0, 2.0]), (4, [2.0, -1.0]), (5, [5e-320, 1e-319])]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


def test_marks_differ_no_more_than_sets():
    for n in (1, 40, 600, 5000):
        a = np.unique(RNG.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[n // 5 :], RNG.integers(0, 2**63, n // 5).astype(np.uint64)])
        differ = jaccard_join.marks_of(a) ^ jaccard_join.marks_of(b)
        assert len(differ) == len(jaccard_join.MARKS)
        assert np.unpackbits(differ.view(np.uint8)).sum() <= len(np.setxor1d(a, b))


def test_jaccard_join_of_many_pairs_and_a_common_shingle(spark, monkeypatch):
    """Pairs too many to be sent to the sets give the same classes; a passage that all share links nothing."""
    monkeypatch.setattr(jaccard_join, "SMALL_ROWS", 0)
    words = [f"w{k}" for k in range(400)]
    base = [words[int(k)] for k in RNG.integers(0, 400, 60)]
    rows = []
    for k in range(30):
        own = list(base)
        for at in RNG.integers(0, 60, k % 6):
            own[int(at)] = f"x{k}_{at}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, " ".join(base[:12] + [f"y{k}_{j}" for j in range(40)])) for k in range(20)]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    want = groups(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(want[100 + k] == 100 + k for k in range(20)) and len(set(want.values())) < 45


def test_jaccard_join_joins_near_copies_by_few_links(spark, monkeypatch):
    """A group of near copies gives one link a node at most, and known components are not joined again."""
    edges = []

    def counted(links):
        edges.append(links.count())
        return components(links)

    monkeypatch.setattr(jaccard_join, "components", counted)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base[: 2 * k] + [f"x{k}"] + base[2 * k + 1 :])) for k in range(80)]
    rows += [(100 + k, " ".join(f"y{k}_{j}" for j in range(30))) for k in range(10)]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: i if i >= 100 else 0 for i, _ in rows}
    assert sum(edges) < 80


def test_merged_components(spark):
    def table(rows, names):
        return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names))

    joined, new = jaccard_join.merged(table([], ["node", "component"]), table([(2, 3), (3, 2), (7, 8), (9, 8)], "uv"))
    assert new == 3 or new == 4
    assert {tuple(r) for r in joined.collect()} == {(2, 2), (3, 2), (7, 7), (8, 7), (9, 7)}
    joined, new = jaccard_join.merged(joined, table([(3, 9), (9, 2), (3, 1), (20, 21), (7, 9)], "uv"))
    assert sorted(tuple(r) for r in joined.collect()) == [(1, 1), (2, 1), (3, 1), (7, 1), (8, 1), (9, 1), (20, 20), (21, 20)]
    again, new = jaccard_join.merged(joined, table([(3, 9), (21, 20)], "uv"))
    assert new == 0 and again is joined


def test_pairs_are_made_once(spark):
    """Rows of a pair that shares many tokens fall to those up to the least shared one that both nodes name."""
    lists = {k: np.sort(RNG.choice(2000, 300, replace=False)) for k in range(12)}
    rows = [(int(t), k, 1 if at % 10 else 2) for k, tokens in lists.items() for at, t in enumerate(tokens)]
    held = spark.createDataFrame(rows, "token long, node long, level int")
    held = held.join(jaccard_join.least_tokens(held), "node", "left")
    right = held.select("token", F.col("node").alias("b"), F.col("least").alias("least_b"))
    both = held.join(right, "token").filter("node < b")
    every, made = both.count(), both.filter(jaccard_join.first_shared())
    assert made.select("node", "b").distinct().count() == both.select("node", "b").distinct().count() == 66
    named = both.filter(F.size(F.array_intersect("least", "least_b")) > 0).select("node", "b").distinct()
    some = made.join(named, ["node", "b"], "left_semi").groupBy("node", "b").count().agg(F.max("count")).first()
    assert made.count() < every and (some[0] is None or some[0] < 20)


def test_copies_of_texts_that_share_an_id(spark):
    """Each text under an id goes by its own group; a text held only by rows without an id still bridges."""
    base = [f"w{k}" for k in range(60)]
    one, other = " ".join(base), " ".join(f"v{k}" for k in range(60))
    near = " ".join(base[:30] + ["z"] + base[31:])
    rows = [
        (1, one, "a"), (2, near, "b"), (2, other, "c"), (2, other, "c"), (3, other, "d"), (4, "", "e"), (4, "", "e"),
        (5, "short text", "f"), (5, "another text", "g"), (None, one, "h"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = jaccard_join.without_copies(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["node"]) for r in kept.collect())
    assert got == [(0, "h"), (1, "a"), (2, "c"), (4, "e"), (5, "f"), (5, "g")]
    far = " ".join(base[:24] + ["y"] + base[25:30] + ["z"] + base[31:])
    chain = [(7, one), (None, near), (8, far)]
    found = jaccard_join.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {7: 7, None: 7, 8: 7}


@pytest.mark.parametrize("tiles", [1, 2, 5, 6])
def test_vector_dedup_deals_two_copies_a_round(tiles, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(vector_dedup, "TILE", 64)
    monkeypatch.setattr(vector_dedup, "TILE_BYTES", 0)
    monkeypatch.setattr(vector_dedup, "ROUND_BYTES", 0)
    n = 64 * tiles
    plans = {8: vector_dedup.Plan(8, n, 0.95)}
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n)), pa.array(np.ones(n, np.int64)), pa.array(RNG.normal(size=(n, 8)).tolist(), pa.list_(pa.float32()))], ["node", "w", "v"]
    )
    met = {}
    for meeting in vector_dedup._rounds(plans):
        out = pa.Table.from_batches(vector_dedup._deal(plans, meeting)(iter([batch])))
        assert out.num_rows <= 2 * n and out.column("v").type == pa.list_(pa.float32())
        for left, right, home, node in zip(*(out.column(c).to_pylist() for c in ("left", "right", "home", "node"))):
            assert home in (left, right)
            met.setdefault(frozenset((left, right)), []).append(node)
    assert plans[8].tiles == tiles and len(met) == tiles * (tiles + 1) // 2
    of = {node: tile for pair, nodes in met.items() if len(pair) == 1 for node in nodes for tile in pair}
    assert len(of) == n and all(sorted(nodes) == sorted(k for k in of if of[k] in pair) for pair, nodes in met.items())


def test_vector_dedup_of_single_precision_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE", 16)
    monkeypatch.setattr(vector_dedup, "TILE_BYTES", 0)
    monkeypatch.setattr(vector_dedup, "ROUND_BYTES", 0)
    base = RNG.normal(size=(6, 40))
    rows = [(k, (base[k % 6] + RNG.normal(size=40) * 0.15).astype(np.float32).tolist()) for k in range(70)]
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows}
    want = {k: (sum(unit[k] @ unit[o] >= 0.95 for o in unit if o != k), g) for k, g in groups(unit, lambda a, b: a @ b >= 0.95).items()}
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()} == want


def test_mixing_broadcasts_no_blocks_or_rows(spark):
    rows = [(k, "a " * (k % 7) * 40, f"s{k % 3}" if k % 5 else None) for k in range(120)] + [(None, None, "s0"), (None, " ", None)]
    made = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=16)
    for frame in (made.pieces(), made.taken(), running_total(spark.range(50), "id", F.col("id"), ["id"], F.lit(1), "n")):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
    taken = made.taken().collect()
    assert collections.Counter((r["id"], r["size"]) for r in taken) == collections.Counter((i, len((t or "").split())) for i, t, _ in rows)
    assert all((r["taken"] == 0) == (r["size"] == 0) for r in taken if r["source"] != "s1") and all(r["taken"] <= 2 * r["size"] for r in taken)

"""Suffix dedup, phrase collocations and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import collocations, queries, suffix_dedup, turn_repair
from weft.llm.suffix_dedup import WIDTH, remove_repeats


def prose(seed, size, letters="abcdefgh  é"):
    r = random.Random(seed)
    return "".join(r.choice(letters) for _ in range(size))


def removed_spans(texts):
    """Per text the maximal spans of bytes that a repeated string of WIDTH bytes covers."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + WIDTH] for r in raws for i in range(len(r) - WIDTH + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - WIDTH + 1):
            if seen[r[i : i + WIDTH]] > 1:
                gone[i : i + WIDTH] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone].astype(int)))
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist())))
    return raws, out


def check_removal(made, texts):
    raws, spans = removed_spans([t for _, t in texts])
    want = sorted(
        (repr(k), len(r), s, r if not s else b"".join(r[a:b] for a, b in zip([0] + [e for _, e in s], [b for b, _ in s] + [len(r)])))
        for (k, _), r, s in zip(texts, raws, spans)
    )
    got = sorted((repr(r["doc_id"]), r["repeat"]["n_bytes"], list(zip(r["repeat"]["starts"], r["repeat"]["ends"])), bytes(r["repeat"]["kept"])) for r in made)
    assert got == want
    for r in made:
        assert r["repeat"]["n_removed"] == sum(e - s for s, e in zip(r["repeat"]["starts"], r["repeat"]["ends"]))


def repeated_texts():
    passage, other = prose(1, 260), prose(2, 900)
    return [
        (1, prose(3, 300) + passage + prose(4, 500)),
        (2, passage + prose(5, 100)),
        (3, prose(6, 50) + passage[20:] + prose(7, 10)),
        (4, other), (5, other), (5, other),  # repeated rows
        (6, other[:450] + "x" + other[451:]),
        (7, "a" * 1000), (8, "ab" * 400), (9, "a" * 199), (10, "a" * 200 + prose(8, 30)),  # overlapping repeats
        (11, prose(9, 150) + passage[:199] + prose(10, 150)),  # one byte short
        (None, passage), (12, None), (13, ""), (14, prose(11, 400) * 3),
        (15, "é" * 300), (16, "e" + "é" * 150),
    ]


def test_removal_equals_brute_force(spark):
    texts = repeated_texts()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    check_removal(remove_repeats(docs).collect(), texts)


def test_removal_of_large_buckets_by_counting(spark):
    passage = prose(20, 230)
    texts = [(i, prose(100 + i, 90) + passage + prose(200 + i, 90)) for i in range(12)] + repeated_texts()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    check_removal(remove_repeats(docs, most=3).collect(), texts)


def test_removal_in_a_text_read_in_pieces(monkeypatch):
    text = prose(30, 30_000) + prose(31, 600) + prose(32, 5000) + prose(31, 600)
    raw = np.frombuffer(text.encode(), np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 4096)
    starts = []
    for _, _, first, last, _, _ in suffix_dedup._sliced(batch):
        starts += [x for a, b in zip(first.tolist(), last.tolist()) for x in range(a, b + 1)]
    assert starts == list(range(len(raw) - WIDTH + 1))


def test_equal_strings_have_equal_anchors():
    shared = prose(40, 700).encode()
    a, b = (np.frombuffer(prose(s, 333 + s).encode() + shared + prose(s + 9, 200).encode(), np.uint8) for s in (41, 42))
    seen = []
    for raw in (a, b):
        at = raw.tobytes().index(shared)
        _, first, last, bucket, _ = suffix_dedup.anchors(raw, np.array([0, len(raw)]))
        of = np.repeat(bucket, last - first + 1)
        seen.append(of[at : at + len(shared) - WIDTH + 1].tolist())
    assert seen[0] == seen[1]


@pytest.mark.parametrize("seed", range(5))
def test_ranks_refine_to_repeated_starts(seed):
    r = random.Random(seed)
    parts = [prose(seed * 50 + k, 400, "ab") for k in range(3)]
    runs = [(parts[r.randrange(3)][r.randrange(100) :] + prose(r.random(), 30)).encode() for _ in range(8)]
    raw, at = np.frombuffer(b"".join(runs), np.uint8), np.r_[0, np.cumsum([len(x) for x in runs])]
    seen = Counter(x[i : i + WIDTH] for x in runs for i in range(len(x) - WIDTH + 1))
    want = [a + i for a, x in zip(at.tolist(), runs) for i in range(len(x) - WIDTH + 1) if seen[x[i : i + WIDTH]] > 1]
    assert sorted(suffix_dedup.repeated_starts(raw, at).tolist()) == want


def test_removal_keeps_columns_and_takes_empty_tables(spark):
    docs = spark.createDataFrame(
        [("k", "t" * 300, 1, True, 2), (None, None, None, None, None)], "k1 string, body string, place int, row boolean, `a.b` int"
    )
    made = remove_repeats(docs, "body", marks="kept")
    assert made.columns == ["k1", "body", "place", "row", "a.b", "kept"]
    rows = {r["k1"]: r for r in made.collect()}
    assert rows[None]["body"] is None and rows[None]["kept"]["n_bytes"] == 0
    assert rows["k"]["kept"]["n_removed"] == 300 and rows["k"]["body"] == "t" * 300
    assert remove_repeats(docs.limit(0), "body").count() == 0


# Collocations


def phrases(rows, least=10, most=2000):
    counts, words = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for m in (1, 2, 3):
                for i in range(len(w) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        wanted = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in wanted.items():
            if len(p) == 3:
                for short in (p[:2], p[1:]):
                    longest[short] = max(longest[short], a)
        found = []
        for p, a in wanted.items():
            if 100 * longest[p] >= 50 * a:
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def chatter(seed, size):
    r = random.Random(seed)
    words = ["the", "The", "en", "es", "of", "new", "york", "city", "é", "a"] + [f"w{k}" for k in range(20)]
    return "".join(r.choice(words) + r.choice([" ", " ", " ", " \t", ", ", ".\n", " ", "\x0b"]) for _ in range(size))


def talk():
    rows = [(r, chatter(k, 300)) for k, r in enumerate(["en", "es", "en", None, "und", "de"] * 6)]
    rows += [("en", "new york city! " * 40), ("en", "new york, " * 11), ("fr", "x y. " * 10 + "y x " * 9), ("en", None), (None, ""), ("en", " \t.,")]
    return rows + rows[:2]


def test_collocations_equal_brute_force(spark, monkeypatch):
    rows = talk()
    docs = spark.createDataFrame([(i, lang, text, 1) for i, (lang, text) in enumerate(rows)], "x long, lang string, text string, f int")
    made = collocations.best(collocations.collocations(docs))
    assert sorted(tuple(r) for r in made.collect()) == phrases(rows)
    assert sorted(tuple(r) for r in collocations.best(collocations.collocations(docs), 3).collect()) == phrases(rows, most=3)


def test_collocations_by_buckets_and_small_flushes():
    rows = talk()
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows]), pa.array([g or "und" for g, _ in rows])], names=["text", "lang"])
    name, follows, *_ = collocations.named_words(batch.column(0), batch.column(1))
    whole = collocations.counted(name, follows, len(name))
    parts = []
    for k in range(0, len(name), 97):
        size = min(97, len(name) - k)
        for bucket, value in collocations.messages(*collocations.counted(name[k : k + size + 2], follows[k : k + size + 2], size), 5):
            parts.append((bucket, collocations._read(value)))
    x, y, z, n = collocations.merged([p for _, p in parts])
    vocabulary = whole[0]
    want = Counter(dict(zip(zip(*(vocabulary[c].tolist() for c in whole[1:4])), whole[4].tolist())))
    assert dict(zip(zip(x.tolist(), y.tolist(), z.tolist()), n.tolist())) == want
    owner = {}
    for bucket, (a, b, _, _) in parts:
        for key in zip(a.tolist(), b.tolist()):
            assert owner.setdefault(key, bucket) == bucket


def test_cut_scores_pass_64_bits(spark):
    a, left, right = 3_000_000_000_000, 4_000_000_000_000, 5_000_000_000_000
    df = spark.createDataFrame([(a, left, right), (10, 10, 10)], "a long, l long, r long")
    got = [r[0] for r in df.select(collocations.cut_score(df.a, df.l, df.r)).collect()]
    assert got == [1000000 * a * a // (left * right), 1000000]


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).count() == 0


# Conversations


def cheapest_by_search(turns):
    """(cost, audit) over the states of the grammar; up to four insertions in a row."""

    @lru_cache(None)
    def go(i, state, inserted):
        found = [(0, "")] if i == len(turns) and state in (0, 3) else []
        following, code = {0: "su", 1: "u", 2: "a", 3: "u"}[state], {"s": 1, "u": 2, "a": 3}
        if i < len(turns):
            initial, must_go, truncated = turns[i]
            cost, audit = go(i + 1, state, 0)
            found.append((cost + 3, "D" + audit))
            for t in following if not must_go else "":
                if t == initial or t != "s":
                    cost, audit = go(i + 1, code[t], 0)
                    found.append((cost + truncated + 2 * (t != initial), ("K" if t == initial else "R") + audit))
        for t in following.replace("s", "") if inserted < 4 else "":
            cost, audit = go(i, code[t], inserted + 1)
            found.append((cost + 2, "I" + audit))
        return min(found, default=(10**9, ""))

    return go(0, 0, 0)


@pytest.mark.parametrize("seed", range(8))
def test_alignment_equals_search(seed):
    r = random.Random(seed)
    for _ in range(250):
        turns = tuple((r.choice(["s", "u", "a", "u", "a", "t", " ", ""]), r.random() < 0.15, r.random() < 0.25) for _ in range(r.randint(0, 9)))
        cost, audit, target = turn_repair.align(turns)
        assert (cost, audit) == cheapest_by_search(turns)
        assert re.fullmatch("(s?(ua)+)?", target)


def test_alignment_of_a_long_conversation_is_banded():
    turns = tuple(("ua"[k % 2], False, False) for k in range(4000))
    table = turn_repair.Table(turns, turn_repair.greedy(turns))
    assert table.rows.shape[1] == 2
    assert turn_repair.align(turns) == (0, "K" * 4000, "ua" * 2000)


def text_of(value):
    return " " if value is None else str(value)


def repaired_by_hand(rows):
    """The contract's row of each conversation."""
    groups = {}
    for conv, turn, role, text in rows:
        own = groups.setdefault(conv, [])
        code = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            own += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        kinds = []
        for k, (_, role, text) in enumerate(own):
            solid = re.findall("[^\x20\x09-\x0d]", text)
            before = [(r, t) for _, r, t in own[:k]]
            kinds.append("blank" if not solid else "duplicate" if (role, text) in before else "" if solid[-1] in ".!?" else "truncated")
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        shape = tuple((r[:1], k in ("blank", "duplicate"), k == "truncated") for (_, r, _), k in zip(own, kinds))
        cost, audit = cheapest_by_search(shape)
        lines, rest = [], iter(own)
        for edit in audit:
            _, role, text = next(rest) if edit != "I" else (0, "", "")
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if lines and lines[-1][0] == "u" else "user"
            lines.append(f"{role}:{text}")
        out.append((
            conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(map(repr, out))


def test_repair_equals_brute_force(spark):
    r = random.Random(5)
    rows = []
    for conv in [None, *range(120)]:
        for turn in [None, *range(r.randint(0, 6)), 9]:
            role = r.choice(["user", "assistant", "system", "tool", None, ""])
            rows.append((conv, turn, role, r.choice(["Hello.", "Why", "Fine!\n", " \t", "", None, "Ça va? ", "yes. no", "u" * 50])))
    rows += rows[:10]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = turn_repair.digest(turn_repair.repair(turn_repair.damage(frame), present_col="present"))
    assert made.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(repr(tuple(r)) for r in made.collect()) == repaired_by_hand(rows)


def test_repair_of_whole_turns_and_of_nothing(spark):
    rows = [("c", 1, "user", "Hi.", 5), ("c", 2, "user", "Hi there.", 5), ("c", 4, "assistant", "Yes.", 5), ("d", None, None, None, 5)]
    frame = spark.createDataFrame(rows, "id string, turn int, role string, text string, cost int")
    made = {r["id"]: r for r in turn_repair.repair(frame, id_col="id").collect()}
    c = made["c"]
    assert (c["gaps"], c["illegal"], c["cost"], c["audit"]) == (1, 1, 2, "KIKK")
    assert c["roles"] == ["user", "assistant", "user", "assistant"] and c["texts"] == ["Hi.", "", "Hi there.", "Yes."]
    assert made["d"]["blank"] == 1 and made["d"]["audit"] == "D" and made["d"]["roles"] == []
    assert turn_repair.repair(frame.limit(0), id_col="id").count() == 0


def test_contract_columns(spark):
    sf_dir = "/root/testdata/sf0.001"
    want = {
        "op11_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op12_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
        "op13_turn_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, sf_dir).columns == columns

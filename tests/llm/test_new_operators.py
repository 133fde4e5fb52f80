"""Resampling, chat formatting and lexical search against brute force, with nulls, long texts, ties and repeated rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SCHEMA, prose, rows_of
from tests.llm.test_operators import lettered
from tidemark.llm import chat, lexical, lm_score, resample, textcore

# 4: LM scoring


def test_lm_scores_do_not_depend_on_partitions(spark, docs):
    """Equal scores for the same rows in 1, 3 and 8 partitions, and in another order."""
    rows = docs.unionByName(spark.createDataFrame(rows_of([prose(i, 80) for i in range(120)], 1000), SCHEMA))
    found = []
    for dealt in (rows.coalesce(1), rows.repartition(3), rows.repartition(8, "n_chars"), rows.orderBy(F.desc("text")).coalesce(2)):
        scored = lm_score.score_texts(dealt, F.col("doc_id") % 5 == 0).collect()
        found.append(sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.base_score, r.score) for r in scored))
    for other in found[1:]:
        for a, b in zip(found[0], other, strict=True):
            assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-12) and math.isclose(a[4], b[4], rel_tol=1e-12)


def test_lm_words_of_one_form_depend_on_what_is_before(spark):
    """400 words of one length and ending, more than have places of their own, each after one and the same word: a text with
    its words so is likelier than one with the same words after others."""
    pairs = [(f"ctx{i % 20}q", f"word{i:03d}xx") for i in range(400)]
    texts = [" ".join(f"{a} {b}" for a, b in (pairs[(i * 7 + j * 13) % 400] for j in range(60))) for i in range(200)]
    some = pairs[:20]
    held = [" ".join(f"{a} {b}" for a, b in some), " ".join(f"{a} {b}" for (a, _), (_, b) in zip(some, some[1:] + some[:1]))]
    got = {r.doc_id: r for r in lm_score.score_texts(spark.createDataFrame(rows_of([*texts, *held]), SCHEMA), F.col("doc_id") >= 200).where("held_out").collect()}
    assert got[200].n_known == got[201].n_known == 41 and math.isclose(got[200].base_score, got[201].base_score, rel_tol=1e-12)
    assert got[200].score > got[201].score + 20 * 0.3


@pytest.mark.parametrize("groups", [1, 3])
def test_lm_words_of_a_place_and_unseen_ones_add_up_to_one(groups, tmp_path):
    """Over all words, with any weights and with common words taken out of their kinds' branches."""
    rng = np.random.default_rng(8)
    words, side = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)), 4
    words[1:9] = words[0] + np.arange(1, 9, dtype=np.uint64) * np.uint64(1 << 13)
    words = np.unique(words)
    kinds = np.where(np.arange(len(words)) < 9, 77, rng.integers(0, 5000, len(words)) % 7 * 512).astype(np.uint32)
    counts = rng.geometric(0.02, len(words)).astype(np.int64)
    b = lm_score._ranges_of(words, kinds, groups)
    deals = [pa.table({"b": [i], "chunk": ["c"], "words": [words[b == i].tobytes()], "kinds": [kinds[b == i].tobytes()], "counts": [counts[b == i].astype(np.int32).tobytes()]}) for i in np.unique(b)]
    parts = [lm_score._totals(f"file://{tmp_path}")(t).to_pylist()[0] for t in deals]
    shared, by_kind = np.zeros((2, side * side), np.int64), np.zeros((lm_score.KINDS, 1 << lm_score.FIRST_BITS), np.int64)
    for p in parts:
        tokens = np.frombuffer(p["tokens"], np.int64).reshape(2, -1)
        by_kind[:, p["b"] // groups] += tokens.sum(0)
        for k in range(2):
            np.add.at(shared[k], lm_score.Layout.shared_places(np.arange(lm_score.KINDS), side), tokens[k])
    order = np.argsort(-counts, kind="stable")
    layout = lm_score.Layout.of(words[order], kinds[order], counts[order], *shared, side, (64, 128))
    tree = lm_score.Tree.of(side, by_kind, words[order], kinds[order], counts[order], len(words))
    assert tree.masses.min() >= 0 and (tree.masses > 0).any()
    chunk = lm_score.Chunk(words, kinds, counts.astype(np.int32), np.arange(len(words)), np.array([len(words)]))
    places, shares, _, c, forks = lm_score._placed(layout, tree, chunk, groups, parts)
    assert (c == counts).all() and (np.diff(forks.first)[~shares] == 0).all() and np.diff(forks.first)[:9].min() > 1
    weights = rng.normal(size=(tree.rows, 2)).astype(np.float32)
    hashes = np.repeat(rng.integers(0, 1 << 60, (lm_score.FEATURES, 1)).astype(np.uint64), len(words), axis=1)
    gains = forks.log_gains(np.arange(len(words)), hashes, weights)
    assert np.abs(gains[shares]).max() > 1 and (gains[~shares] == 0).all()
    whole = np.bincount(places, 10.0 ** (layout.log_shared(places, shares, c) + gains), side * side)
    for place in np.unique(places[shares]):
        assert math.isclose(whole[place] + 1 / (layout.tokens[place] + layout.distinct[place] + 1), 1, rel_tol=1e-5)


def test_lm_chunk_files_are_packed(spark, tmp_path):
    """They hold the tokens as they are, in at most two thirds of what plain numbers take."""
    rows = spark.createDataFrame(rows_of([prose(i, 200) for i in range(150)]), SCHEMA).coalesce(1)
    rows = rows.selectExpr("doc_id", "doc_id % 7 = 2", "text", "0 AS part")
    got = [r.asDict() for r in rows.mapInArrow(lm_score._chunks(f"file://{tmp_path}", 1), lm_score._CHUNK_DDL).collect()]
    plain = sum(16 * r["n_words"] + 4 * r["n_tokens"] + 4 * r["n_docs"] for r in got)
    assert sum(f.stat().st_size for f in tmp_path.iterdir() if f.name.startswith("chunks-")) < plain * 2 / 3
    texts = {r.doc_id: (r.text or "").encode() for r in rows.collect()}
    for r in got:
        chunk, raws = lm_score.Chunk.of(r), [texts[k] for k in r["keys"]]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in raws])])
        sizes, tokens, kinds = lm_score._tokens(np.frombuffer(b"".join(raws), np.uint8), offs)
        assert (chunk.sizes == sizes).all() and (chunk.words[chunk.ids] == tokens).all() and (chunk.kinds[chunk.ids] == kinds % lm_score.KINDS).all()
        learnt = np.repeat(~np.array(r["held"]), sizes)
        assert (chunk.counts == np.bincount(chunk.ids[learnt], minlength=len(chunk.words))).all()


def test_lm_sums_two_in_one_number_are_exact():
    """Where one weight row gets everything, more than a number holds at once."""
    rng = np.random.default_rng(3)
    sums, want = lm_score.RowSums((16, 8)), np.zeros((16, 8), np.int64)
    for k in range(6):
        rows, values = (np.full(lm_score.SEEN_TOKENS, 5) if k < 4 else rng.integers(0, 16, lm_score.SEEN_TOKENS)).astype(np.uint16), rng.integers(0, lm_score.UNITS + 1, (lm_score.SEEN_TOKENS, 8)).astype(np.float32)
        values[:, 3] = lm_score.UNITS
        sums.add(rows, lm_score.RowSums.packed(values))
        np.add.at(want, rows, values.astype(np.int64))
    sums.take_apart()
    assert (sums.out == want).all()


def test_lm_fork_sums_equal_plain_loops(monkeypatch):
    """Words with up to six forks, sums taken apart often, against a loop over tokens, forks and features."""
    rng = np.random.default_rng(4)
    n, width, rows = 6, 5, 1 << 10
    each = [lm_score.Paths(rng.integers(0, 1 << 32, (-(-k // 4), width)).astype(np.uint32), rng.integers(2, 32, (k, width)), rng.normal(size=(k, width)).astype(np.float32), np.zeros(width)) for k in range(1, n + 1)]
    words = rng.permutation((n + 1) * width).astype(np.int32)  # ranks: the first words have no forks
    forks = lm_score.Forks(np.zeros(0), words, np.arange(1, n + 2) * width, each)
    ids, hashes = rng.integers(0, len(words), 4000), rng.integers(0, 1 << 62, (lm_score.FEATURES, 4000)).astype(np.uint64) % np.uint64(50)
    weights = (rng.normal(size=(rows, 2)) / 4).astype(np.float32)
    monkeypatch.setattr(lm_score, "MOST_ADDED", 1 << 10)
    seen, expected = forks.seen(ids, hashes, weights)
    gains, lead = forks.log_gains(ids, hashes, weights), (weights - weights[:, ::-1]).reshape(-1).astype(np.float64)
    want, gain = np.zeros((2, 2 * rows)), np.zeros(4000)
    for t, w in enumerate(words[ids].tolist()):
        k, column = divmod(w, width)
        for f in range(k):
            paths = each[k - 1]
            at = [((((int(h) + int(paths.blocks[f // 4, column])) % 2**32 * 0x9E3779B1) % 2**32 >> 21) & ~1) ^ int(paths.cells[f, column]) for h in hashes[:, t]]
            p = 1 / (1 + math.exp(-lead[at].sum() - float(paths.logits[f, column])))
            gain[t] += math.log10(p)
            for a in at:
                want[:, a] += 1, p * lm_score.UNITS
                want[1, a ^ 1] += (1 - p) * lm_score.UNITS
    assert (seen.reshape(-1) == want[0]).all() and np.allclose(gains, gain, atol=1e-5)
    assert (np.abs(expected.reshape(-1) - want[1]) <= 0.51 * (want[0] + want[0].reshape(-1, 2)[:, ::-1].reshape(-1)) + 1e-6).all()


# 11: importance resampling


def features_of(text):
    words = lettered(text)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_draw(docs, target, buckets, seed, share, least):
    """(key, features, weight, score, rank) of each (key, text)."""
    s, t = collections.Counter(), collections.Counter()
    for texts, count in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            count.update(zlib.crc32(f.encode()) % buckets for f in features_of(x))
    whole, aim = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * whole / ((s[b] + 1) * aim))) for b in range(buckets)]
    rows = []
    for key, text in docs:
        f = features_of(text)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(lettered(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[: share * len(able) // 100]
    return collections.Counter([(*r[:4], k) for k, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in able[len(drawn) :]] + [(*r[:4], None) for r in rows if not r[4]])


@pytest.mark.parametrize(("share", "least", "pieces"), [(25, 20, 1 << 20), (60, 1, 64), (100, 0, 7)])
def test_resampling(spark, docs, texts, share, least, pieces, monkeypatch):
    monkeypatch.setattr(resample, "PIECE_BYTES", pieces)
    target = [texts[2], texts[7][:200], None, ""]
    aims = spark.createDataFrame([(x, "k") for x in target], "text string, doc_id string")
    got = resample.resample(docs, aims, buckets=500, seed=3, share=share, least_words=least)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == plain_draw(rows, target, 500, 3, share, least)


def test_resampling_in_small_pieces():
    """Words and pairs over the cuts of a text, and words longer than those that are hashed together."""
    texts = ["aa bb" * 30 + " " + "x" * 300 + " é " + "y" * 90, "", "z" * 400 + " a", "one", " . "]
    data, offs = textcore.buffers(pa.array(texts))
    for size in (5, 17, 1 << 20):
        found = collections.defaultdict(collections.Counter)
        for lo, words, pairs, text, of in resample.features(data, offs, 1 << 32, size):
            for b, i in [*zip(words.tolist(), text.tolist()), *zip(pairs.tolist(), of.tolist())]:
                found[lo + i][b] += 1
        assert [found[i] for i in range(len(texts))] == [collections.Counter(zlib.crc32(f.encode()) for f in features_of(x)) for x in texts]


def test_resampling_of_empty_tables_and_other_keys(spark, docs, empty):
    aims = spark.createDataFrame([("a b",)], "text string")
    assert resample.resample(empty, aims).count() == 0
    no_aims = resample.resample(docs, aims.limit(0), share=50)
    assert no_aims.count() == docs.count() and no_aims.where("rank is not null").count() == 50 * docs.where("size(split(text, ' ')) >= 20").count() // 100
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert resample.resample(named, aims).schema["doc_id"].dataType.simpleString() == "string"


def test_resampling_ties_and_one_key(spark):
    """One id for all rows, with equal texts: one score, ranks without gaps."""
    same = spark.range(40).select(F.lit(5).alias("doc_id"), F.lit(prose(1, 30)).alias("text"))
    got = resample.resample(same, same.limit(1), share=30).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 13)) and len(got) == 40


# 12: chat formatting

CHATS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "[\\INST] <\\\\s> <<SYS>> [/INST"), (1, 2, "assistant", ""), (1, 3, "assistant", "b[AND]c\n"), (1, None, "tool[IS]", "x[IS]y"),
    (None, 1, None, None), (None, 0, "user", "["), (2, 0, "assistant", " "), (2, 0, "assistant", " "), (3, 5, "system", "<<SYS>>\U0001f600<</SYS>>"), (3, 6, "system", "é" * 3000), (3, 7, "user", " pad "), (4, 0, "ROLE", "[ROLE] [/ROLE]"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*r, "f", []) for r in CHATS], "conv_id long, turn long, role string, text string, formatted string, loss_mask array<int>").repartition(3)
    made = chat.format_turns(turns)
    assert made.columns == ["conv_id", "formatted", "loss_mask"]
    got = {r.conv_id: r for r in made.select("*", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    digests = {r.conv_id: r for r in chat.digests(made).collect()}
    assert set(got) == {r[0] for r in CHATS}
    for key, row in got.items():
        want = sorted((r for r in CHATS if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want = [(r[2] or "", r[3] or "") for r in want]
        assert [(t.role, t.text) for t in row.turns] == want
        said = "".join(x for role, x in want if role == "assistant")
        d = digests[key]
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(want), len(said), len(row.formatted))
        assert d.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for role, x in want).encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        masked = {i for s in row.loss_mask for i in range(s.start, s.start + s.length)}
        bare = "".join(c if i not in masked else "\0" for i, c in enumerate(row.formatted))
        assert not re.search("[^\0]", "".join(re.findall(r"<s> (.*?) </s>", bare, re.S)).replace("[AND]", ""))
        # Marks open and close the blocks of merged turns, and stand nowhere else.
        blocks = sum(1 for i, w in enumerate(want) if i == 0 or want[i - 1][0] != w[0])
        assert len(re.findall("|".join(map(re.escape, [*chat.OPEN.values(), chat.OTHER_OPEN])), row.formatted)) == blocks


def test_chat_escapes_whatever_texts_hold(spark):
    rng = np.random.default_rng(3)
    bits = [*chat.MARKS, "\\", "<", "[", ">", "]", "s", "/", " ", "INST]", "é"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 9))) for _ in range(400)]
    rows = [(i // 7, i % 7, ["user", "assistant", "x"][rng.integers(0, 3)], x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_turns(df).select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).orderBy("conv_id").collect()
    assert [(t.role, t.text) for r in got for t in r.t] == [(role, x) for _, _, role, x in rows]


def test_chat_of_many_turns_and_of_none(spark):
    turns = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id % 3 = 0, 'user', 'assistant')").alias("role"), F.expr("concat('t', id)").alias("text"))
    row = chat.digests(chat.format_turns(turns)).first()
    assert row.n_turns == 3000 and row.loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(3000) if i % 3).encode()).hexdigest()
    assert chat.digests(chat.format_turns(turns.limit(0))).count() == 0


# 13: ranked lexical search


def plain_search(docs, items, k=10):
    """(item, rank, key, score) of each (item, text)."""
    counts = [(key, collections.Counter(lettered(x))) for key, x in docs]
    counts = [(key, c) for key, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for key, c in counts:
            m = 25 + 75 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in lettered(text) if t in c)
            if s > 0:
                found.append((-s, key is None, key or 0))
        out += [(item, rank, None if none else key, -s) for rank, (s, none, key) in enumerate(sorted(found)[:k], 1)]
    return collections.Counter(out)


@pytest.mark.parametrize(("k", "pairs", "block"), [(10, 1 << 20, 1 << 20), (2, 3, 1), (40, 50, 30)])
def test_lexical_search(spark, docs, texts, k, pairs, block, monkeypatch):
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    asked = [(0, texts[3]), (0, texts[4][:90]), (None, "one ONE two"), (7, None), (8, "nothing of it"), (9, texts[5][:40] + " " + texts[3][:60] * 3), (10, " . ")]
    items = spark.createDataFrame([(*r, 1, 2) for r in asked], "item_id long, text string, score int, rank int").repartition(2)
    got = lexical.search(docs, items, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == plain_search([(r.doc_id, r.text) for r in docs.collect()], asked, k)


def test_lexical_search_with_bounds_that_prune(spark, monkeypatch):
    """Common words that all share don't lead, and the result is that of all pairs, however documents are dealt out."""
    rows = [(i, " ".join(["the of and"] * 5) + " " + prose(i, 15) + (" rare word" if i % 40 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows_of([x for _, x in rows]), SCHEMA)
    asked = [(i, f"the of and {' '.join(rows[i][1].split()[15:20])} rare") for i in range(0, 40, 4)]
    items = spark.createDataFrame(asked, "item_id long, text string")
    want = plain_search(rows, asked)
    for parts in (1, 6):
        assert collections.Counter(map(tuple, lexical.search(docs.repartition(parts), items).collect())) == want


def test_lexical_search_of_empty_tables_and_other_keys(spark, docs, empty):
    items = spark.createDataFrame([(1, "ba de")], "item_id long, text string")
    assert lexical.search(empty, items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    kinds = dict(lexical.search(named, items.select(F.lit("a").alias("item_id"), "text")).dtypes)
    assert kinds == {"item_id": "string", "rank": "int", "doc_id": "string", "score": "bigint"}


# The pipeline


def test_stages_with_columns_of_any_name_and_kind(spark, tmp_path):
    """Columns named as the stages name theirs, and a map: near copies go, one of each repeated row stays, and no value
    changes."""
    a, b = prose(1, 60), prose(2, 60)
    near = a.replace(a.split()[30], "changed", 1)
    rows = [(0, a, 77, {"k": 1}, "en", "src0", 1), (1, near, 88, {"k": 2}, "en", "src0", 2), (2, b, 99, {}, "en", "src0", 3), (2, b, 98, None, "en", "src0", 3), (None, a, 1, {"z": 0}, "en", "src0", 4), (3, None, 5, {"n": 3}, "en", "src0", 5), (3, "", 6, {}, None, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long, doc map<string,int>, lang string, source string, row long")
    key = lambda r: (r[0], r[1], r[2], str(r[3]), *r[4:])
    d = str(tmp_path)
    spark.createDataFrame([(1, prose(9, 20))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    kept = collections.Counter(key(tuple(r)) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, d).collect())
    whole = collections.Counter(map(key, rows))
    assert kept <= whole and kept[key(rows[0])] == 1 and kept[key(rows[1])] == 0
    assert kept[key(rows[2])] + kept[key(rows[3])] == 1 and all(kept[key(r)] == 1 for r in rows[4:])
    for parts in (1, 5):
        assert collections.Counter(key(tuple(r)) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs.repartition(parts), d).collect()) == kept
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, d)
        assert got.columns == docs.columns and collections.Counter(key(tuple(r)) for r in got.collect()) <= whole, name

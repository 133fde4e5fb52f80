"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables, and clashing columns."""

import collections
import hashlib
import json
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SCHEMA, prose, rows_of
from tidemark.llm import common, decontaminate, graph, licenses, lm_score, media, mixing, ngram_join, queries, quality, sharding, textcore, token_files, url_rules

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def lettered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def all_rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


# 1: URL filters

URLS = [None, "", "http://", "nourl", "HTTP://WWW.Example.com/en/1", "http://example.com/en/", "http://a.b.example.com/EN/", "http://notexample.com/en/x", "https://x.net/es/?q", "https://x.net/fr", "http://x.net?/fr/", "http://example.com", "http://com/", "a://b://c.com/d", "http://é.com/ü#x", "http://x.com:80/", "http://x.net/es/" + "a" * 9000]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOW)
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


@pytest.mark.parametrize(("limit", "of_map"), [(url_rules.BROADCAST_RULES, url_rules.MAP_RULES), (url_rules.BROADCAST_RULES, 0), (0, 0)])
def test_url_rules(spark, limit, of_map, monkeypatch):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", limit)
    monkeypatch.setattr(url_rules, "MAP_RULES", of_map)
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate([*URLS, URLS[4]])] + [(None, URLS[8], "h", 1)], "page_id long, url string, host string, token int")
    got = url_rules.judge(pages, queries.URL_RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[8] if r.page_id is None else [*URLS, URLS[4]][r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(url), url
    assert url_rules.judge(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, [], default="block").collect()} == {"block"}


def test_url_rule_tokens():
    assert url_rules.Rule("block", "spam-x.com", "/a/bc").tokens == ["a", "com", "spam", "x"]


# 2: token files


def test_token_files(docs, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    manifest = token_files.write_tokens(docs, f"file://{tmp_path}/a", queries.tokenizer_path(), 2)
    got = sorted(token_files.read_documents(manifest).collect(), key=lambda r: r.start)
    rows = sorted(all_rows(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    part = manifest.first()
    data, offsets, ids = token_files.open_part(part.file, part.width)
    assert part.width == 2 and len(offsets) == len(ids) + 1 == part.n_docs + 1 and len(data) == part.n_ids
    none = token_files.write_tokens(empty, f"file://{tmp_path}/b", queries.tokenizer_path(), 2)
    assert token_files.read_documents(none).count() == 0


def test_encoding_by_word_equals_whole_texts(texts):
    by_word, whole = (token_files.WordEncoder(queries.tokenizer_path(), w) for w in (True, False))
    for t in texts:
        assert by_word.encode(t or "") == whole.encode(t or "")


def test_only_known_tokenizers_go_by_word():
    import public_tokenizers

    assert token_files.WordEncoder(queries.tokenizer_path()).by_word
    assert not token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json")).by_word
    spec = json.loads(open(queries.tokenizer_path()).read())
    for change in ({"normalizer": {"type": "Prepend", "prepend": "_"}}, {"pre_tokenizer": None}, {"added_tokens": [{"content": "a b", "lstrip": False, "rstrip": False, "single_word": False}]}):
        assert not token_files.splits_at_spaces({**spec, **change})


# 3: media columns


def test_media_round_trip(docs, empty, tmp_path):
    index = media.store_payloads(docs, f"file://{tmp_path}/m")
    got = media.read_features(index).collect()
    want = collections.Counter((i, hashlib.sha256(media.pad((t or "").encode())).hexdigest()) for i, t in all_rows(docs))
    assert collections.Counter((r.doc_id, r.payload_sha256) for r in got) == want
    text = {i: (t or "").encode() for i, t in all_rows(docs) if i is not None}
    for r in got:
        raw = text.get(r.doc_id, b"no id")
        assert r.n_bytes == len(raw) and r.payload_bytes % 576 == 0 and r.payload_bytes == 576 * r.height and r.width == 576
        assert r.tail_crc32 == zlib.crc32(media.pad(raw)[-32:]) and r.feature == media.feature(media.pad(raw))
        assert r.media_sha256 == hashlib.sha256(media.encode_png(media.pad(raw))).hexdigest()
    assert media.read_features(media.store_payloads(empty, f"file://{tmp_path}/n")).count() == 0
    stored = index.select("shard", "digest", "offset").distinct()
    assert stored.count() == index.select("shard", "digest").distinct().count()


def test_tar_members_are_readable(docs, tmp_path):
    import tarfile

    row = media.store_payloads(docs, f"file://{tmp_path}/t").first()
    with tarfile.open(common.local_path(row.shard)) as tar:
        member = tar.getmember(f"{row.digest}.png")
        data = tar.extractfile(member).read()
    assert member.offset_data == row.offset and member.size == row.length
    assert hashlib.sha256(media.decode_png(data)).hexdigest() == row.digest


# 4: LM scoring


def test_lm_scores(spark, docs, empty):
    got = lm_score.score_texts(docs, common.crc32_mod("doc_id", 7) == 2, steps=3).collect()
    rows = all_rows(docs)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [(i, [*spaced(t), None]) for i, t in rows]
    counts = collections.Counter(w for i, ws in tokens for w in ws if not held(i))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_score.score_texts(empty, F.lit(False), steps=1).count() == 0
    nothing = lm_score.score_texts(docs, F.lit(True), steps=1).collect()
    assert {r.n_known for r in nothing} == {0} and {r.train_tokens for r in nothing} == {0}


def small_layout(side=4, rows=(64, 128)):
    rng = np.random.default_rng(1)
    words, counts = rng.integers(1, 1 << 60, 30).astype(np.uint64), np.arange(30, 0, -1)
    kinds = rng.integers(0, 4096, 30)
    shared = np.zeros((2, side * side), np.int64)
    places = lm_score.Layout.shared_places(kinds, side)
    np.add.at(shared[0], places, counts)
    np.add.at(shared[1], places, 1)
    return lm_score.Layout.of(words, kinds, counts, *shared, side, rows), words, kinds, counts


def test_word_probabilities_add_up_to_one():
    layout, words, kinds, counts = small_layout()
    rng = np.random.default_rng(2)
    weights = tuple(rng.normal(size=(r, layout.side)).astype(np.float32) for r in (layout.class_rows, layout.place_rows))
    places, shares = layout.places_of(words, kinds)
    assert (~shares).sum() == 8 and layout.tokens.sum() == layout.train_tokens == counts.sum() and layout.distinct.sum() == 30
    context = rng.integers(0, 1 << 60, (lm_score.FEATURES, 1)).astype(np.uint64)
    every = np.arange(layout.side**2)
    of_place = 10 ** lm_score.log_probabilities(np.repeat(context, len(every), 1), every, layout, weights)
    assert abs(of_place.sum() - 1) < 1e-5
    known = (of_place[places] * 10 ** layout.log_shared(places, shares, counts)).sum()
    shared = np.setdiff1d(every, layout.common_places)
    unseen = (of_place[shared] / (layout.tokens[shared] + layout.distinct[shared] + 1)).sum()
    assert abs(known + unseen - 1) < 1e-5


def test_contexts_see_words_before_but_not_other_texts():
    tokens = np.array([11, 12, 13, 14, 11, 12, 13], np.uint64)
    c = lm_score.contexts(tokens, np.array([1, 2, 3, 4, 1, 2, 3]), np.array([4, 3]))
    assert (c[:, 0] == c[:, 4]).all() and (c[:, 2] == c[:, 6]).all() and (c[:, 1] != c[:, 2])[0]
    other = lm_score.contexts(tokens, np.array([1, 2, 3, 4, 1, 2, 3]), np.array([7]))
    assert (other[:, 4] != c[:, 4]).any() and (other[:, :4] == c[:, :4]).all()


def test_lm_equals_plain_model(spark):
    """One gradient step over one chunk, with loops and dictionaries."""
    texts = [" ".join(f"{'abc'[j % 3]}{(i * j) % 7}" for j in range(4 + 3 * i)) for i in range(9)]
    got = {r.doc_id: r.score for r in lm_score.score_texts(spark.createDataFrame(rows_of(texts), SCHEMA).coalesce(1), F.col("doc_id") == 4, steps=1).collect()}

    def hashed(w):
        raw = np.frombuffer(w.encode(), np.uint8)
        return textcore.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0], int(lm_score.word_kinds(raw, np.array([0]), np.array([len(raw)]))[0])

    docs = [[*map(hashed, t.split()), (lm_score._END, 0)] for t in texts]
    counts = collections.Counter(w for i, d in enumerate(docs) if i != 4 for w in d)
    side, *rows = lm_score.Layout.sizes(len(counts))
    common = {w: r % side * side + r // side for r, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], int(x[0][0].view(np.int64))))[: side * (side // 2)])}
    place = lambda w: common.get(w, w[1] % side * side + side // 2 + w[1] // side % (side - side // 2))
    n, d = collections.Counter(), collections.Counter()
    for w, c in counts.items():
        n[place(w)] += c
        d[place(w)] += 1
    assert len(counts) > len(common) or side == 8

    def features(doc, i):
        before = lambda k: doc[i - k] if i >= k else None
        made = [0 if before(k) is None else place(before(k)) + 1 for k in range(1, lm_score.BACK + 1)]
        one, two = (0 if before(k) is None else int(before(k)[0]) for k in (1, 2))
        made.append((one * int(lm_score._ODD) + two) % 2**64)
        return [int(textcore.mix(np.array([(x + (k + 1) * int(lm_score._ODD)) % 2**64], np.uint64))[0]) for k, x in enumerate(made)]

    weights = [collections.defaultdict(float), collections.defaultdict(float)]

    def factors(f, c):
        of_class = [h % rows[0] for h in f]
        of_place = [int(textcore.mix(np.array([(h + c * int(lm_score._SALT)) % 2**64], np.uint64))[0]) % rows[1] for h in f]
        a = [math.log((sum(n[k * side + s] for s in range(side)) + 1) / (sum(n.values()) + side)) + sum(weights[0][r, k] for r in of_class) for k in range(side)]
        b = [math.log(n[c * side + s] + 0.5) + sum(weights[1][r, s] for r in of_place) for s in range(side)]
        return [(r, [math.exp(v) / sum(map(math.exp, x)) for v in x]) for r, x in ((of_class, a), (of_place, b))]

    seen, expected = [collections.Counter() for _ in range(2)], [collections.Counter() for _ in range(2)]
    for j, doc in enumerate(docs):
        for i, w in enumerate(doc if j != 4 else []):
            c, s = divmod(place(w), side)
            for k, (r, p) in enumerate(factors(features(doc, i), c)):
                for row in r:
                    seen[k][row, (c, s)[k]] += 1
                    for y, v in enumerate(p):
                        expected[k][row, y] += v
    for k in range(2):
        for at in set(seen[k]) | set(expected[k]):
            a, b = seen[k][at], expected[k][at]
            weights[k][at] += lm_score.RATE / lm_score.FEATURES * (a - b) / ((a + b) / 2 + 1)
    for j, doc in enumerate(docs):
        want = 0.0
        for i, w in enumerate(doc):
            c, s = divmod(place(w), side)
            (_, a), (_, b) = factors(features(doc, i), c)
            want += math.log10(a[c] * b[s]) + (0 if w in common else math.log10((counts[w] + 1) / (n[place(w)] + d[place(w)] + 1)))
        assert abs(got[j] - want) < 0.01 * len(doc), j


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_lm_beats_unigrams_on_held_out_documents(spark):
    got = queries.op4_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("a"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (got.a - got.b) / got.n > 0.15


def test_long_words_and_texts_hash_alike_in_pieces(monkeypatch):
    raw = ("ab " * 40 + "c" * 1000 + " dé " + "Xy" * 90 + " z").encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = textcore.spans(data, np.array([0, len(data)]), textcore.BY_SPACE)
    want = textcore.word_hashes(data, starts, ends)
    for size in (64, 7, 1):
        monkeypatch.setattr(textcore, "CHUNK_BYTES", size)
        assert (textcore.word_hashes(data, starts, ends) == want).all()


def test_lm_beats_unigrams_on_patterns(spark):
    rows = rows_of([" ".join(["ab", "cd", "ef"] * 50 if i % 2 else ["gh", "ij"] * 70) for i in range(30)])
    got = lm_score.score_texts(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") % 3 == 0).where("held_out").agg(F.sum("score").alias("a"), F.sum("base_score").alias("b")).first()
    assert got.a > got.b


# 5: decontamination


def plain_hits(text, items, window):
    words, hit, found = lettered(text), set(), set()
    for item, t in items:
        w = lettered(t)
        n = min(window, len(w))
        spots = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in spots:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 100])
def test_decontamination(spark, docs, empty, texts, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    words = texts[4].split()
    items = [(1, texts[1]), (2, " ".join(words[5:30]) + " other words"), (3, "no id"), (4, None), (5, ""), (6, "two  WORDS!"), (10, texts[1]), (7, " ".join(words[:12])), (8, texts[22][1000:1400])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_matches(docs, bench).collect()
    want = collections.Counter((i, *plain_hits(t, items, 13)) for i, t in all_rows(docs))
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert {r.longest for r in got if r.doc_id == 1} == {len(lettered(texts[1]))}
    assert all(r.longest == max((m.length for m in r.matches), default=0) for r in got)
    brief = decontaminate.find_matches(docs, bench, detail=False)
    assert collections.Counter(tuple(r)[:7] for r in brief.collect()) == collections.Counter(tuple(r)[:7] for r in got)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r.contaminated for r in got)
    assert decontaminate.find_matches(empty, bench).count() == 0
    assert decontaminate.find_matches(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_single_word_items(spark):
    docs = spark.createDataFrame(rows_of(["a b a", "c"]), SCHEMA)
    got = decontaminate.find_matches(docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_hit, r.n_items) for r in got] == [(2, 1), (0, 0)]


# 6: sharding


@pytest.mark.parametrize(("shards", "atoms"), [(1, 1000), (4, 1000), (4, 16), (2, 8), (60, 5)])
def test_sharding(docs, empty, shards, atoms, monkeypatch):
    monkeypatch.setattr(sharding.minimax_cuts, "__defaults__", (atoms,))
    got = sharding.shard(docs, shards).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in all_rows(docs))
    text = {i: t for i, t in all_rows(docs)}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)
    of = collections.defaultdict(set)
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in got:
        of[text[r.doc_id] or ""].add(r.shard)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(len(s) == 1 for s in of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(shards)) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    first, total = {}, collections.Counter()
    for r in got:
        t = text[r.doc_id] or ""
        i = -(1 << 63) if r.doc_id is None else r.doc_id
        first[t] = min(first.get(t, i), i)
        total[t] += r.size
    groups = [total[t] for t in sorted(total, key=lambda t: (first[t], hashlib.sha256(t.encode()).digest()))]

    def fits(c):
        n = used = 0
        for g in groups:
            if not n or used + g > c:
                n, used = n + 1, 0
            used += g
        return n <= shards

    assert max(sizes.values()) == next(c for c in range(max(max(groups), sum(groups) // shards), sum(groups) + 1) if fits(c))
    assert sharding.shard(empty, 3).count() == 0


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_even_cuts_equal_a_plain_loop(spark, shards):
    rng = np.random.default_rng(shards)
    ends = [int(x) for x in np.cumsum(rng.integers(1, 90, 300))] if shards < 40 else [5, 9, 400, 410]
    row = spark.createDataFrame([(ends,)], "ends array<long>")
    total = ends[-1]
    largest = max(b - a for a, b in zip([0, *ends], ends, strict=False))
    capacity = sharding.smallest_capacity(row, max(largest, -(-total // shards)), total, shards)
    least, place = [], total  # from the end: where the last i + 1 shards can begin
    while place > 0:
        place = min(e for e in [0, *ends] if place - e <= capacity)
        least.append(place)
    want, start = [], 0
    for left in range(shards - 1, 0, -1):
        low = max(start, least[left - 1] if left <= len(least) else 0)
        share = start + (total - start) // (left + 1)
        start = min((e for e in ends if low <= e <= start + capacity), key=lambda e: (abs(e - share), e), default=start)
        want.append(start)
    assert sharding._even_cuts(row, capacity, total, shards) == [*want, total]


# 7: license scans


def test_license_scan(spark, docs, empty):
    notice = licenses.NOTICES[1].text
    lines = [f"{prose(1, 50)} {notice} {prose(2, 30)}", notice.upper() + " " + notice, prose(3, 40), "Released under the MIT License.", None, "", "few words", notice.replace("compliance", "agreement"), prose(4, 20_000) + " " + licenses.NOTICES[4].text]
    got = licenses.scan(spark.createDataFrame(rows_of(lines), SCHEMA)).collect()
    found = {(r.doc_id, r.license): r for r in got}
    assert found[0, "apache-2.0-header"].containment == 1 and 30 <= found[0, "apache-2.0-header"].first_word <= 50
    assert {i for i, n in found if n == "apache-2.0-header"} == {0, 1, 7} and found[7, "apache-2.0-header"].containment < 1
    assert found[1, "apache-2.0-header"].windows > found[0, "apache-2.0-header"].windows
    assert (3, "mit") in found and (8, "gpl-3.0") in found and not {i for i, _ in found} & {2, 4, 5, 6}
    assert licenses.scan(empty).count() == 0 and licenses.scan(docs, []).count() == 0
    assert licenses.scan(docs, [licenses.Template("short", "too few")]).count() == 0
    ids = spark.createDataFrame([(None, *rows_of([notice])[0][1:])], SCHEMA)
    assert {r.doc_id for r in licenses.scan(ids).collect()} == {None}


@pytest.mark.parametrize("switch", ["LISTED", "BROADCAST_SHINGLES"])
def test_license_scan_of_a_long_list(spark, switch, monkeypatch):
    """A table of templates, of which two have one name, and each of the ways around a limit: the same rows."""
    body = prose(77, 400)
    table = spark.createDataFrame([("own", body), ("own", licenses.NOTICES[0].text), (None, None), ("few", "too few")], "name string, text string")
    docs = spark.createDataFrame(rows_of([f"{prose(1, 3000)} {body} {prose(2, 500)} {body}", f"{licenses.NOTICES[0].text} {prose(5, 20)}", body[:1200], None, "", prose(6, 90)] * 2), SCHEMA)
    rows = lambda: sorted(tuple(r) for r in licenses.scan(docs, table).collect())
    want = rows()
    assert [r[0] for r in want] == [0, 1, 6, 7] and want[0][3] == 1.0 and 2800 < want[0][4] <= 3000
    monkeypatch.setattr(licenses, switch, 0)
    assert rows() == want


def test_changed_notices_are_found(spark):
    """One word of a notice changed, in many texts: all that hold 80 hundredths of the shingles are found."""
    rng, rows, want = np.random.default_rng(4), [], 0
    sets = {t.name: {tuple(w[i : i + 5]) for w in [re.findall(r"[a-z0-9]+", t.text.lower())] for i in range(len(w) - 4)} for t in licenses.NOTICES}
    for i in range(300):
        t = licenses.NOTICES[i % len(licenses.NOTICES)]
        words = re.findall(r"[A-Za-z0-9]+", t.text)
        words[int(rng.integers(len(words)))] = "changed"
        held = {tuple(w.lower() for w in words[k : k + 5]) for k in range(len(words) - 4)}
        rows.append(f"{prose(i, 9 + i % 7)} {' '.join(words)} {prose(i + 900, 30)}")
        want += sum(5 * len(s & held) >= 4 * len(s) for s in sets.values())
    assert licenses.scan(spark.createDataFrame(rows_of(rows), SCHEMA)).count() == want > 50


# 8: quality classifier


def labelled(spark, n=120):
    good = [prose(i, 30 + i) for i in range(n)]
    bad = [" ".join(w.upper() + "!!" for w in prose(1000 + i, 40).split()) for i in range(n)]
    docs = spark.createDataFrame(rows_of([*good, *bad]), SCHEMA)
    labels = spark.createDataFrame([(i, int(i < n), 0) for i in range(2 * n)] + [(None, 1, 0), (5, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(spark, docs, empty):
    rows, labels = labelled(spark)
    model = quality.fit(rows, quality.learnable(labels))
    got = quality.classify(rows, model, common.crc32_mod("doc_id", 3) == 1).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == (r.doc_id < 120) for r in got if r.held_out]) > 0.95
    odd = quality.classify(docs, model, F.lit(False)).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    by_text = collections.defaultdict(set)
    text = dict(all_rows(docs))
    for r in odd:
        by_text[text[r.doc_id]].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert quality.keep_good(rows, model).columns == rows.columns
    assert quality.classify(empty, model, F.lit(False)).count() == 0
    assert {s for t, ss in by_text.items() if not t for s in ss} == {0.0}
    none = quality.fit(rows, labels.limit(0))
    assert {r.score for r in quality.classify(rows, none, F.lit(False)).collect()} == {0.5}


def test_quality_learns_one_text_a_key(spark):
    rows, labels = labelled(spark, 40)
    twice = rows.union(rows).union(rows.where("doc_id = 3"))
    one, two = quality.fit(rows, labels, sample=80), quality.fit(twice, labels, sample=80)
    assert len(two.labels) == 80 and two.labels.sum() == 40
    assert np.allclose(one.vectors, two.vectors) and (one.labels == two.labels).all()
    blanks = spark.createDataFrame(rows_of(["", None, " ", "good words here"]), SCHEMA)
    kinds = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    assert quality.fit(blanks, kinds).blank == 3 / 4


def test_fit_equals_plain_space(spark):
    """Terms counted by loops, idf and singular vectors by definition: the same cosines."""
    rows, labels = labelled(spark, 15)
    model = quality.fit(rows, labels)
    texts = {r.doc_id: r.text for r in rows.collect()}
    x = []
    for i in sorted(texts):
        raw, row = texts[i].encode(), np.zeros(quality.TERMS)
        for a in range(len(raw) - 2):
            p, q, r = (int(quality._SHAPE[c]) for c in raw[a : a + 3])
            row[quality._TERM[(p * quality._KINDS + q) * quality._KINDS + r]] += 1
        row[: quality.TRIGRAMS] /= max(1, row[: quality.TRIGRAMS].sum())
        seen, before = set(), None
        for w in spaced(texts[i]):
            b = np.frombuffer(w.encode(), np.uint8)
            row[quality.TRIGRAMS + int(textcore.word_hashes(b, np.array([0]), np.array([len(b)]))[0] % np.uint64(quality.WORDS))] += 1 / len(spaced(texts[i]))
            row[quality.TERMS - 3 + (w in seen) + (w == before)] += 1 / len(spaced(texts[i]))
            seen.add(w)
            before = w
        x.append(np.sqrt(row))
    x = np.array(x)
    idf = 1 + np.log((1 + len(x)) / (1 + (x > 0).sum(0)))
    axes = np.linalg.svd(x * idf, full_matrices=False)[2][: quality.DIMENSIONS]
    latent = (x * idf) @ axes.T
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    got = np.sort((model.vectors @ model.vectors.T).ravel())
    assert np.abs(got - np.sort((latent @ latent.T).ravel())).max() < 0.02


def test_nearest_ties_go_by_number():
    c = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.1, 0.2, 0.3, 0.4, 0.5]])
    assert [sorted(r) for r in quality.nearest(c, 3).tolist()] == [[0, 1, 2], [2, 3, 4]]


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_quality_counts_terms_by_pieces(monkeypatch, piece):
    rng = np.random.default_rng(0)
    parts = [bytes(rng.choice(list(b"aB3 \n,x"), k).astype(np.uint8)) for k in (0, 1, 2, 3, 50, 7, 0, 200, 1)]
    data, offs = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    whole = quality.term_shares(data, offs)
    monkeypatch.setattr(textcore, "CHUNK_BYTES", piece)
    assert (quality.term_shares(data, offs) == whole).all()
    for p, counts in zip(parts, quality._trigram_counts(data, offs), strict=True):
        kind = [int(quality._SHAPE[c]) for c in p]
        terms = [int(quality._TERM[(x * quality._KINDS + y) * quality._KINDS + z]) for x, y, z in zip(kind, kind[1:], kind[2:], strict=False)]
        assert counts.tolist() == np.bincount(np.array(terms, np.int64), minlength=quality.TRIGRAMS).tolist()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables here")
def test_quality_of_held_out_labels(spark):
    """Held-out rows of ``labels``: accuracy and how often a good text scores above a bad one."""
    d = "/root/testdata/sf0.1"
    got = queries.op8_quality(spark, d).where("held_out").join(queries.table(spark, d, "labels"), "doc_id").select("score", "predicted", "quality").toPandas()
    assert len(got) > 1000 and (got.predicted == got.quality).mean() > 0.97
    good, bad = np.sort(got.score[got.quality == 1]), got.score[got.quality == 0]
    auc = ((np.searchsorted(good, bad, "left") + np.searchsorted(good, bad, "right")) / 2 / len(good)).mean()
    assert 1 - auc > 0.97


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    data = [prose(i, 20).encode() for i in range(40)]
    x = quality.term_shares(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    cuts = [slice(0, quality.TRIGRAMS), slice(quality.TRIGRAMS, -3), slice(-3, None)]
    assert all(np.allclose(np.linalg.norm(x[:, c], axis=1), 1) for c in cuts)
    model = quality.Model(rng.normal(size=(quality.TERMS, 8)).astype(np.float32), quality._unit(rng.normal(size=(50, 8)).astype(np.float32)), rng.integers(0, 2, 50).astype(float))
    got = model.score(x)
    for row, s in zip(x, got, strict=True):
        latent = row @ model.weights
        cosines = model.vectors @ (latent / np.linalg.norm(latent))
        best = np.argsort(-cosines)[: quality.NEIGHBOURS]
        votes = np.maximum(cosines[best], 0) ** quality.SHARPNESS
        assert abs(s - (votes * model.labels[best]).sum() / votes.sum()) < 1e-3


# the pipeline, and the operators' SQL


def test_stages_keep_columns_and_odd_rows(spark, tmp_path, docs, empty):
    """Each stage on nulls, blanks, repeats, clashing columns and no rows at all: what goes is what the operator says."""
    d = str(tmp_path)
    texts = [r.text for r in docs.collect() if r.text and len(r.text.split()) > 20]
    spark.createDataFrame([(1, texts[2])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(i not in (16, 17, 18, 21))) for i in range(24)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    rows = collections.Counter(map(tuple, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, d)
        assert kept.columns == docs.columns, name
        got = collections.Counter(map(tuple, kept.collect()))
        assert got <= rows and got, name
        none = stage(spark, empty, d)
        assert none.columns == docs.columns and none.count() == 0, name
        if name == "quality":
            good = {r.doc_id for r in quality.classify(docs, quality.fit(docs, quality.learnable(queries.table(spark, d, "labels"))), F.lit(True)).where("predicted = 1").collect()}
            assert not any(not r[1] for r in got) and {r[0] for r in got} == good
        if name == "mixing":
            mixed = mixing.mix(docs, mixing.targets_table(spark, queries.MIX_TREE), share=corpus_pipeline.MIX_SHARE, epochs=1, seed=20240229)
            assert got == collections.Counter(tuple(r[c] for c in docs.columns) for r in mixed.collect() for _ in range(r.copies))
        if name == "decontamination":
            want = collections.Counter({r: n for r, n in rows.items() if not plain_hits(r[1], [(1, texts[2])], 13)[4]})
            assert got == want
        if name == "near_copies":
            components = collections.Counter(c for (_, n, c), m in plain_components([(r[0], r[1]) for r in rows.elements()]).items() if n and c is not None)
            assert len({(spaced(r[1]) and tuple(spaced(r[1]))) for r in got if r[0] is not None and spaced(r[1])}) == len(components)
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, docs, d).count() == docs.count() and last(spark, empty, d).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_operator_equals_sql(spark, name):
    import duckdb

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, d), con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.select(", ".join(got.columns)).fetchall()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_pipeline_runs_its_stages_in_order(spark):
    d = "/root/testdata/sf0.001"
    docs = queries.table(spark, d, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
    ids = sorted(r.doc_id for r in docs.collect())
    got = corpus_pipeline.run(spark, d).orderBy("start").collect()
    assert [r.doc_id for r in got] == ids and 0 < len(ids) < queries.table(spark, d, "documents").count()
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


# 9: n-gram Jaccard join


def plain_components(rows, k=5, similar=80):
    sets = []
    for i, t in rows:
        w = spaced(t)
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= similar * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return collections.Counter((i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize("limit", [ngram_join.BROADCAST_NODES, 0])
def test_jaccard_components(docs, empty, limit, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_NODES", limit)
    got = collections.Counter(map(tuple, ngram_join.near_components(docs).collect()))
    assert got == plain_components(all_rows(docs))
    assert ngram_join.near_components(empty).count() == 0


@pytest.mark.parametrize("block", [1024, 5])
def test_jaccard_chains_and_large_groups(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    words = prose(7, 100).split()
    chain = [" ".join([f"new{j}" if j < 3 * i else w for j, w in enumerate(words)]) for i in range(12)]
    shared = [prose(50 + i, 25) + " " + prose(7, 8) for i in range(10)]
    rows = rows_of([*chain, *shared, *[chain[4]] * 3])
    got = collections.Counter(map(tuple, ngram_join.near_components(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == plain_components([(r[0], r[1]) for r in rows])


def test_jaccard_links_by_text_where_keys_repeat_or_lack(spark):
    words = prose(7, 100).split()
    a, mid, b = (" ".join([*[f"new{j}" for j in range(m)], *words[m:]]) for m in (0, 6, 12))
    other, far = prose(8, 90), prose(9, 80)
    rows = [(1, a), (None, mid), (2, b), (7, other), (7, far), (7, a), (9, far + " end"), (5, other + " end"), (7, "far away from all"), (None, "no key at all in here"), (None, "no key at all in here x y")]
    rows += [(20, "twice the same text of one key")] * 2 + [(4, ""), (4, "blank and text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(map(tuple, ngram_join.near_components(df).collect())) == plain_components(rows)
    kept = collections.Counter(map(tuple, corpus_pipeline.keep_one_of_near_copies(spark, df, "").collect()))
    gone = [(2, b), (7, a), (7, other), (9, far + " end"), (20, "twice the same text of one key")]
    assert kept == collections.Counter(rows) - collections.Counter(gone)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 41), (41, 40), (50, 50), (None, 3), (7, 7)], "a long, b long")
    got = dict(map(tuple, graph.components(edges).collect()))
    assert got == {**dict.fromkeys(range(21), 0), 40: 40, 41: 40, 50: 50}
    assert graph.components(edges.limit(0)).count() == 0


def test_hashes_of_words_and_shingles():
    texts = ["A b c", "", "b C a b c d e f", "é\u00a0x"]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    starts, ends, bounds = textcore.spans(data, offs, textcore.BY_SPACE)
    assert np.diff(bounds).tolist() == [3, 0, 8, 1]
    h = textcore.word_hashes(data, starts, ends)
    assert h[0] == h[5] and h[1] == h[3] == h[6] and len(set(h.tolist())) == 7
    s, at = textcore.shingle_hashes(h, bounds, 3)
    assert np.diff(at).tolist() == [1, 0, 6, 1] and s[0] == s[3] and len(set(s.tolist())) == 7


# 10: mixing


def plain_fill(budget, children):
    """Fair shares of a budget: (name, weight, room) to tokens."""
    got, left = {}, budget
    order = sorted(children, key=lambda c: (c[2] / c[1] if c[1] else 0.0, c[0]))
    while order:
        name, w, room = order[0]
        whole = sum(c[1] for c in order)
        if room * whole <= left * w:
            got[name], left = room, left - room
            order.pop(0)
        else:
            return got | {n: left * cw // whole for n, cw, _ in order}
    return got


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 1), (0.9, 3), (1.0, 1), (0.0, 1)])
def test_mixing(spark, share, epochs):
    tree = {"a": (3, {"en": (2, {"s0": 1, "s1": 2}), "de": (1, {"s0": 1, "s1": 0})}), "b": (1, {"en": (1, {"s2": 1, "empty": 5})})}
    rows = []
    for i in range(200):
        lang, source = [("en", "s0"), ("en", "s1"), ("de", "s0"), ("de", "s1"), ("en", "s2"), (None, "s0"), ("en", None), ("xx", "s0"), ("en", "s0")][i % 9]
        rows.append((i, None if i % 50 == 7 else "" if i % 50 == 8 else prose(i, 1 + i % 40), lang, source))
    rows += [rows[0], (None, "a b c", "en", "s0")]
    docs = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, last_part int, cut string, rank int")
    got = mixing.mix(docs, mixing.targets_table(spark, tree), share=share, epochs=epochs, seed=5).collect()
    leaves = {(d, g, s): [dw, gw, sw] for d, (dw, gs) in tree.items() for g, (gw, ss) in gs.items() for s, sw in ss.items()}
    supply = {l: sum(len(spaced(t)) for _, t, g, s in rows if (g, s) == l[1:]) for l in leaves}
    room = {l: supply[l] * epochs if all(leaves[l]) else 0 for l in leaves}
    top = plain_fill(min(int(sum(supply.values()) * share), sum(room.values())), [(d, tree[d][0], sum(v for l, v in room.items() if l[0] == d)) for d in tree])
    alloc = {}
    for d, b in top.items():
        for g, bb in plain_fill(b, [(g, tree[d][1][g][0], sum(v for l, v in room.items() if l[:2] == (d, g))) for g in tree[d][1]]).items():
            alloc |= {(d, g, s): v for s, v in plain_fill(bb, [(s, w, room[d, g, s]) for s, w in tree[d][1][g][1].items()]).items()}
    want = collections.Counter()
    for l, a in alloc.items():
        own = [(("null" if i is None else str(i)), i, len(spaced(t))) for i, t, g, s in rows if (g, s) == l[1:]]
        full = a // supply[l] if supply[l] else 0
        groups = collections.defaultdict(list)
        for k, i, n in own:
            groups[hashlib.md5(f"5:{full + 1}:{k}".encode()).hexdigest(), k].append((i, n))
        end = 0
        for _, members in sorted(groups.items()):
            end += sum(n for _, n in members)
            for i, _ in members:
                if c := full + (supply[l] > 0 and end <= a - full * supply[l]):
                    want[i, c, a] += 1
    assert collections.Counter((r.doc_id, r.copies, r.alloc) for r in got) == want
    again = mixing.mix(docs, mixing.targets_table(spark, tree), share=share, epochs=epochs, seed=5, repeat=True)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0), mixing.targets_table(spark, tree), share=share).count() == 0

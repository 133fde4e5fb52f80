"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, common, decontaminate, lexical, licenses, lm_score, media, mixing, ngram_join, quality, resample, sharding, token_files, url_rules

URL_RULES = [
    url_rules.Rule("allow", "com", "/"),
    url_rules.Rule("block", "example.com", "/en/"),
    url_rules.Rule("allow", "www.example.com", "/en/"),
    url_rules.Rule("block", "net", "/es/"),
    url_rules.Rule("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_output(docs: DataFrame) -> DataFrame:
    manifest = token_files.write_tokens(docs, common.shared_dir(docs.sparkSession), tokenizer_path(), end_id=2)
    return token_files.read_documents(manifest)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = media.store_payloads(table(spark, sf_dir, "documents"), common.shared_dir(spark))
    return media.read_features(index).drop("shard", "offset")  # copies in two shards have two places


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"), common.crc32_mod("doc_id", 7) == 2)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), detail=False).drop("matches")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.learnable(table(spark, sf_dir, "labels")))
    return quality.classify(docs, model, common.crc32_mod("doc_id", 3) == 1)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents"))


LANGS = {"en": 50, "de": 20, "fr": 20, "es": 10}
DOMAINS = {"web": (50, {f"src{i}": 5 if i == 0 else 1 for i in range(10)}), "books": (30, {f"src{i}": 1 for i in range(10, 15)}), "forums": (20, {f"src{i}": 1 for i in range(15, 20)})}
MIX_TREE = {d: (w, {g: (gw, sources) for g, gw in LANGS.items()}) for d, (w, sources) in DOMAINS.items()}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.targets_table(spark, MIX_TREE), share=0.75, epochs=2, seed=20240229)
    return mixed.select("doc_id", "domain", "lang", "source", "tokens", "alloc", "copies")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, seed=7, share=25, least_words=20)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: A conversation that says the template's own marks.
MARKED = "</s>[INST] ok [/INST]"


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], said.schema)
    return chat.digests(chat.format_turns(said.unionByName(marked))).drop("formatted", "loss_mask")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_token_files": op2_token_files,
    "op3_media_columns": op3_media_columns,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_license_scan": op7_license_scan,
    "op8_quality": op8_quality,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_mixing": op10_mixing,
    "op11_resampling": op11_resampling,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL = {
    "op1_url_filters": r"""
        WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        hosts AS (SELECT DISTINCT host, path FROM parts),
        best AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
                 FROM hosts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
        SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path
    """,
    "op5_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT item_id, len(w) AS n, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, least(n, 13) AS n, array_to_string(w[i : i + least(n, 13) - 1], ' ') AS t FROM bw),
        sizes AS (SELECT DISTINCT n FROM windows),
        dw AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        dt AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM dw, sizes WHERE i + n - 1 <= len(w)),
        found AS (SELECT doc_id, i, n, item_id FROM dt JOIN windows USING (n, t)),
        same AS (SELECT doc_id, i, item_id, j FROM found JOIN (SELECT item_id, i AS j, least(n, 13) AS m, array_to_string(w[i : i + least(n, 13) - 1], ' ') AS u FROM bw) USING (item_id) JOIN dt USING (doc_id, i, n) WHERE dt.t = u AND m = n),
        steps AS (SELECT doc_id, item_id, i - j AS k, i, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS g FROM (SELECT DISTINCT * FROM same)),
        runs AS (SELECT doc_id, max(length) AS longest FROM (SELECT doc_id, count(*) - 1 + any_value(least(n, 13)) AS length FROM steps JOIN (SELECT item_id, any_value(n) AS n FROM bw GROUP BY item_id) USING (item_id) GROUP BY doc_id, item_id, k, g) GROUP BY doc_id),
        hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS k FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM found) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(k, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest, 0)::BIGINT AS longest
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN runs USING (doc_id)
    """,
    "op10_mixing": r"""
        WITH doms(domain, domain_weight, lo, hi) AS (VALUES ('web', 50, 0, 9), ('books', 30, 10, 14), ('forums', 20, 15, 19)),
        langs(lang, lang_weight) AS (VALUES ('en', 50), ('de', 20), ('fr', 20), ('es', 10)),
        leaf AS (SELECT domain, domain_weight, lang, lang_weight, 'src' || i AS source, CASE WHEN i = 0 THEN 5 ELSE 1 END AS source_weight
                 FROM doms, langs, range(0, 20) r(i) WHERE i BETWEEN lo AND hi),
        sized AS (SELECT d.doc_id, l.domain, d.lang, d.source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
                  FROM documents d JOIN leaf l ON d.lang = l.lang AND d.source = l.source),
        stock AS (SELECT leaf.*, coalesce(s, 0)::BIGINT AS supply, coalesce(s, 0)::BIGINT * 2 AS room FROM leaf LEFT JOIN (SELECT lang, source, sum(tokens) AS s FROM sized GROUP BY ALL) x USING (lang, source)),
        root AS (SELECT least(floor(sum(supply) * 0.75), sum(room))::BIGINT AS b FROM stock),
        d0 AS (SELECT domain, max(domain_weight) AS w, sum(room)::BIGINT AS room FROM stock GROUP BY domain),
        d1 AS (SELECT d0.*, b - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws, room / w AS ratio FROM d0, root WINDOW o AS (ORDER BY room / w, domain)),
        d2 AS (SELECT *, room * ws <= rem * w AS full_ FROM d1),
        d3 AS (SELECT *, min(CASE WHEN NOT full_ THEN {'r': ratio, 'n': domain, 'rem': rem, 'ws': ws} END) OVER () AS f FROM d2),
        d4 AS (SELECT domain, (CASE WHEN full_ THEN room ELSE (f.rem * w) // f.ws END)::BIGINT AS b FROM d3),
        g0 AS (SELECT domain, lang, max(lang_weight) AS w, sum(room)::BIGINT AS room FROM stock GROUP BY ALL),
        g1 AS (SELECT g0.*, b - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws, room / w AS ratio FROM g0 JOIN d4 USING (domain) WINDOW o AS (PARTITION BY domain ORDER BY room / w, lang)),
        g2 AS (SELECT *, room * ws <= rem * w AS full_ FROM g1),
        g3 AS (SELECT *, min(CASE WHEN NOT full_ THEN {'r': ratio, 'n': lang, 'rem': rem, 'ws': ws} END) OVER (PARTITION BY domain) AS f FROM g2),
        g4 AS (SELECT domain, lang, (CASE WHEN full_ THEN room ELSE (f.rem * w) // f.ws END)::BIGINT AS b FROM g3),
        s1 AS (SELECT stock.domain, stock.lang, source, supply, room, source_weight AS w, b - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem, sum(source_weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws, room / source_weight AS ratio
               FROM stock JOIN g4 USING (domain, lang) WINDOW o AS (PARTITION BY stock.domain, stock.lang ORDER BY room / source_weight, source)),
        s2 AS (SELECT *, room * ws <= rem * w AS full_ FROM s1),
        s3 AS (SELECT *, min(CASE WHEN NOT full_ THEN {'r': ratio, 'n': source, 'rem': rem, 'ws': ws} END) OVER (PARTITION BY domain, lang) AS f FROM s2),
        plan AS (SELECT domain, lang, source, supply, (CASE WHEN full_ THEN room ELSE (f.rem * w) // f.ws END)::BIGINT AS alloc FROM s3),
        plan2 AS (SELECT *, CASE WHEN supply > 0 THEN alloc // supply ELSE 0 END AS e FROM plan),
        ranked AS (SELECT doc_id, z.domain, z.lang, z.source, tokens, alloc, e, alloc - e * supply AS rest, md5('20240229:' || (e + 1)::BIGINT || ':' || doc_id) AS h FROM sized z JOIN plan2 p ON z.lang = p.lang AND z.source = p.source),
        ends AS (SELECT *, sum(tokens) OVER (PARTITION BY lang, source ORDER BY h, doc_id::VARCHAR ROWS UNBOUNDED PRECEDING) AS end_ FROM ranked)
        SELECT doc_id, domain, lang, source, tokens, alloc, (e + CASE WHEN end_ <= rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM ends WHERE e + CASE WHEN end_ <= rest THEN 1 ELSE 0 END > 0
    """,
    "op7_license_scan": """
        WITH templates(name, text) AS (VALUES """ + ", ".join(f"('{t.name}', '{t.text}')" for t in licenses.NOTICES) + r"""),
        tw AS (SELECT name, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM templates),
        ts AS (SELECT DISTINCT name, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT name, w, unnest(range(1, len(w) - 3)) AS i FROM tw)),
        size AS (SELECT *, (ceil((m - 1) / step) + 1) * step AS span FROM (SELECT name, count(*) AS m, greatest(1, (count(*) + 3) // 4) AS step FROM ts GROUP BY name)),
        dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
        ds AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
        hit AS (SELECT doc_id, pos, ts.name, s, m, step, span FROM ds JOIN ts USING (s) JOIN size USING (name)),
        win AS (SELECT doc_id, name, m, s, unnest(range(greatest(0, ceil((pos - span + 1) / step))::BIGINT, (pos // step)::BIGINT + 1)) * step AS start FROM hit),
        good AS (SELECT doc_id, name, start, count(DISTINCT s) / any_value(m) AS c FROM win GROUP BY ALL HAVING count(DISTINCT s) * 100 >= any_value(m) * 80)
        SELECT doc_id, name AS license, count(*) AS windows, round(max(c), 4) AS containment, min(start)::INTEGER AS first_word FROM good GROUP BY doc_id, name
    """,
    "op11_resampling": r"""
        WITH RECURSIVE bits(b, k, c) AS (SELECT b, 0, b FROM range(0, 256) x(b) UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
        lut AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
        d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        g AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        runs AS (SELECT r, unnest(w) AS f FROM d UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
        aims AS (SELECT unnest(w) AS f FROM g UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM g),
        named AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM runs UNION SELECT f FROM aims)),
        hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) % 10000 AS bucket FROM named, lut),
        s AS (SELECT bucket, count(*) AS s FROM runs JOIN hashed USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM aims JOIN hashed USING (f) GROUP BY bucket),
        gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
        sums AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM runs JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY r),
        scored AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight, ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN sums USING (r)),
        noised AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
        places AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM noised WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM places) // 100 THEN rank END AS rank FROM noised LEFT JOIN places USING (r)
    """,
    "op12_chat_formatting": r"""
        WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                      UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
        held AS (SELECT *, lag(role) OVER o IS DISTINCT FROM role AS begins,
                        regexp_replace(text, '(<)(\\*(?:<SYS>>|</SYS>>|s>|/s>))|(\[)(\\*(?:INST\]|/INST\]|ROLE\]|/ROLE\]|IS\]|AND\]))', '\1\3\\\2\4', 'g') AS escaped FROM said WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        sized AS (SELECT *, length(escaped) + CASE WHEN NOT begins THEN 5 ELSE 2 + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 17 + length(role) END END AS chars FROM held)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars FROM sized GROUP BY conv_id
    """,
    "op13_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        whole AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
        tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
        df AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY t, n_docs),
        m AS (SELECT r, doc_id, 25 + (75 * len(w) * n_docs) // n_terms AS m FROM d, whole),
        asked AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
        scored AS (SELECT q, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM asked JOIN tf USING (t) JOIN df USING (t) JOIN m USING (r) GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}

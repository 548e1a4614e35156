"""One query for each operator, over whole tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe, decontaminate, divergence, exact, langid, licenses, mixing, neardup, quality, resample, revisits, rollup, substring
from tracewright.llm.common import UPPER, table, work_dir, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WORD_TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    model = langid.PPM.fit(docs.where("not held_out and lang is not null"))
    return langid.predict(docs, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"), licenses.known(spark))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a BPE vocabulary and by words, a snapshot, then two more batches: words are counted anew
    without digits, and documents labelled toxic are taken down from both. The first batch is sent twice, as after
    a failure, and counts once."""
    docs, root = table(spark, sf_dir, "documents"), work_dir(spark)
    bpe = written(rollup.bpe_counts(docs, TOKENIZER, "byte_bpe_50k"), "counts")
    words = written(rollup.word_counts(docs), "counts")
    plain = written(rollup.word_counts(docs.withColumn("text", F.regexp_replace("text", "[0-9]+", ""))), "counts")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    rollup.commit(root, "load-bpe", rollup.inserted(bpe))
    rollup.commit(root, "load-words", rollup.inserted(words))
    rollup.compact(spark, root)
    rollup.commit(root, "revise-words", rollup.revised(words, plain))
    rollup.commit(root, "takedown", rollup.deleted(bpe.unionByName(plain).join(toxic, "doc_id", "left_semi")))
    rollup.commit(root, "load-bpe", rollup.inserted(bpe))
    return rollup.totals(spark, root)


def records(pages: DataFrame) -> DataFrame:
    """A crawl from ``pages``: each page is answered in full once, and asked again later with its entity tag."""
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    page = pages.select("page_id", "url", tag.alias("tag"), F.octet_length("html").cast("string").alias("size"))
    date = lambda ts: F.concat(F.lit("t"), ts.cast("string"))
    first, later = F.col("page_id") * 2, (F.col("page_id") + (F.col("page_id") % 7) * 500) * 2 + 1
    full = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size"), F.lit("etag"), F.col("tag"), F.lit("date"), date(first))
    short = F.create_map(F.lit("etag"), F.concat(F.lit("W/"), F.col("tag")), F.lit("date"), date(later), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=60"))
    row = lambda i, kind, ts, headers, payload: page.select(i.alias("record_id"), F.lit(kind).alias("kind"), "url", ts.alias("ts"), headers.alias("headers"), payload.alias("payload"))
    return row(F.col("page_id") * 2, "response", first, full, F.col("tag")).unionByName(row(F.col("page_id") * 2 + 1, "revisit", later, short, F.lit(None).cast("string")))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisits.resolve(records(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda x: F.concat_ws(": ", x["key"], x["value"])))
    return out.select("record_id", "canonical_url", "response_id", "outcome", F.array_join(lines, "|").alias("headers"), "payload")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text", "factors")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_dedup(table(spark, sf_dir, "documents"), percent=85)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return bpe.decode(encoded, WORD_TOKENIZER).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_language_id, op2_quality, op3_license_scan, op4_decontaminate, op5_token_rollup, op6_warc_revisits, op7_exact_dedup, op8_mix_sources, op9_substring_dedup, op10_near_dedup, op11_importance_resampling, op12_source_divergence, op13_bpe, pipeline]
    return {f.__name__: f for f in ops}


def duck(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def replaced(expr: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        to = re.sub(r"\$\{?(\d)\}?", r"\\\1", to)
        to = f"chr(10)" if to == "\n" else duck(to)
        expr = f"regexp_replace({expr}, {duck(pattern)}, {to}, 'g')"
    return expr


def canonical_sql(text: str) -> str:
    return f"trim(regexp_replace({replaced(f'lower({text})', licenses.STEPS)}, {duck('^' + chr(10) + '|' + chr(10) + '$')}, '', 'g'))"


def oracle_sql() -> dict[str, str]:
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    notices = ", ".join(f"({duck(name)}, {duck(text)})" for name, text in licenses.TEXTS + licenses.NOTICES)
    long_texts = ", ".join(f"({duck(name)}, {duck(digest)}, {n}, {duck(head)})" for name, digest, n, _, head in licenses.DIGESTS)
    words = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
    low = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    feature_words = f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    host = "regexp_extract(url, '^([A-Za-z]+://)?([^/?#]*)', 0)"
    url = replaced(f"lower({host}) || substr(url, length({host}) + 1)", revisits.URL_STEPS)
    return {
        "op3_license_scan": f"""
            WITH texts AS (SELECT id, trim(replace({canonical_sql('t')}, chr(10), ' ')) AS t FROM (VALUES {notices}) v(id, t)),
            known AS (SELECT digest, min(id) AS license_id, any_value(n) AS n, any_value(head) AS head FROM (
              SELECT sha256(t) AS digest, id, len(string_split(t, ' ')) AS n, array_to_string(string_split(t, ' ')[1:{licenses.HEAD}], ' ') AS head FROM texts UNION ALL SELECT digest, id, n, head FROM (VALUES {long_texts}) v(id, digest, n, head)) GROUP BY 1),
            canon AS (SELECT row_number() OVER () AS r, doc_id, {canonical_sql("coalesce(text, '')")} AS c FROM documents),
            lines AS (SELECT r, license_id FROM (SELECT r, sha256(trim(unnest(string_split(c, chr(10))))) AS digest FROM canon) JOIN known USING (digest)),
            maybe AS (SELECT r, c, string_split(replace(c, chr(10), ' '), ' ') AS w FROM canon WHERE regexp_matches(c, (SELECT string_agg(DISTINCT replace(head, ' ', '[ ' || chr(10) || ']'), '|') FROM known WHERE n >= {licenses.LEAST}))),
            starts AS (SELECT r, sum(n) OVER (PARTITION BY r ORDER BY i) - n AS s FROM (SELECT r, i, len(string_split(c[i], ' ')) AS n FROM (SELECT r, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT r, string_split(c, chr(10)) AS c FROM maybe)))),
            runs AS (SELECT r, license_id FROM starts b JOIN maybe USING (r) JOIN known k ON k.n >= {licenses.LEAST} AND array_to_string(w[s + 1:s + {licenses.HEAD}], ' ') = head
              WHERE sha256(array_to_string(w[s + 1:s + k.n], ' ')) = digest AND (s + k.n = len(w) OR EXISTS (FROM starts e WHERE e.r = b.r AND e.s = b.s + k.n))),
            per AS (SELECT r, count_if(line) AS n, count_if(NOT line) AS m, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS names FROM (SELECT *, true AS line FROM lines UNION ALL SELECT *, false FROM runs) GROUP BY r)
            SELECT doc_id, license_id AS text_license, coalesce(per.n, 0)::BIGINT AS notices, coalesce(m, 0)::BIGINT AS contained, names AS licenses, digest
            FROM (SELECT r, doc_id, sha256(trim(replace(c, chr(10), ' '))) AS digest FROM canon) LEFT JOIN per USING (r) LEFT JOIN known USING (digest)""",
        "op6_warc_revisits": f"""
            WITH page AS (SELECT page_id, {url} AS key, '"' || md5(html) || '"' AS tag, strlen(html) AS size FROM pages),
            ask AS (SELECT page_id * 2 + 1 AS record_id, key, tag, (page_id + (page_id % 7) * 500) * 2 + 1 AS ts FROM page),
            best AS (SELECT record_id, max(page_id) AS page_id FROM ask JOIN page USING (key) WHERE page.page_id * 2 < ask.ts GROUP BY record_id),
            row AS (SELECT ask.*, page.page_id * 2 AS response_id, page.tag AS old, page.size FROM ask LEFT JOIN best USING (record_id) LEFT JOIN page USING (page_id))
            SELECT record_id, row.key AS canonical_url, response_id,
                   CASE WHEN response_id IS NULL THEN 'missing' WHEN tag = old THEN 'resolved' ELSE 'mismatch' END AS outcome,
                   CASE WHEN tag = old THEN 'cache-control: max-age=60|content-length: ' || size || '|content-type: text/html|date: t' || ts || '|etag: W/' || tag END AS headers,
                   CASE WHEN tag = old THEN old END AS payload
            FROM row""",
        "op7_exact_dedup": f"""
            WITH d AS (SELECT doc_id, sha256({lower}) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256 FROM d WINDOW g AS (PARTITION BY text_sha256)""",
        "op9_substring_dedup": f"""
            WITH d AS (SELECT doc_id, coalesce({words.format("text")}, []) AS w FROM documents),
            win AS (SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
            dup AS (SELECT doc_id, i FROM win JOIN (SELECT x, min(doc_id) AS m FROM win GROUP BY x) USING (x) WHERE doc_id > m),
            gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM dup),
            per AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
            SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
                   sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
            FROM d LEFT JOIN per USING (doc_id)""",
        "op10_near_dedup": f"""
            WITH RECURSIVE d AS (SELECT doc_id, coalesce({words.format(low)}, []) AS w FROM documents),
            sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
            links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
                      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
            reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
            SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
            FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n""",
        "op11_importance_resampling": f"""
            WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
            d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({feature_words}, []) AS w FROM documents),
            b AS (SELECT coalesce({feature_words}, []) AS w FROM benchmark),
            df AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
            bf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
            hex AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
            hashed AS (SELECT f, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) % 10000 AS bucket FROM hex, crc),
            s AS (SELECT bucket, count(*) AS n FROM df JOIN hashed USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM bf JOIN hashed USING (f) GROUP BY 1),
            total AS (SELECT (SELECT count(*) FROM df)::DOUBLE AS s, (SELECT count(*) FROM bf)::DOUBLE AS t),
            gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (total.s + 10000) / ((s.n + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (bucket), total),
            sums AS (SELECT r, count(*) AS n, sum(g)::BIGINT AS g FROM df JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY r),
            scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS weight,
              floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN sums USING (r)),
            ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS k, count(*) OVER () * 25 // 100 AS most FROM scored WHERE n_words >= 20)
            SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, weight::BIGINT + noise AS score, CASE WHEN k <= most THEN k END AS rank FROM scored LEFT JOIN ranked USING (doc_id)""",
        "op12_source_divergence": f"""
            WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({lower}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
            seen AS (SELECT r, lang, source, unnest(w) AS term FROM d),
            vocab AS (SELECT lang, term, count(*) AS n FROM seen GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
            langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM vocab GROUP BY lang),
            groups AS (SELECT DISTINCT lang, source FROM d),
            dense AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, vocab.n AS all_n FROM groups JOIN vocab USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM seen GROUP BY ALL) c USING (lang, source, term)),
            p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p, 1 + 1000000000::HUGEINT * (all_n + 5) // (total + 5 * v) AS q FROM dense JOIN langs USING (lang)),
            apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
            pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(apart.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
            found AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
            SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM found) WHERE part = 'pair' OR rank <= 50""",
    }

"""One query per operator of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (containment, licenses, merkle, minhash, mixing, packing, phrases, records, repeats, secrets,
                          syncmers, toxicity, urls)
from tidemark.llm.base import table
from tidemark.llm.catalog import register


def tokenizer_path() -> str:
    """The public byte-level BPE file, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op6_token_records")
def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op7_near_duplicates", """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
             ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) AS s FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b
        ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (WITH RECURSIVE r(id, c) AS (SELECT doc_id, doc_id FROM d
        UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id) SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM s JOIN r ON r.id = s.doc_id
""")
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


@register("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.held_out(F.col("doc_id"))
    scores = toxicity.toxicity_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out))
    return scores.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@register("op9_benchmark_items", r"""
WITH raw AS (SELECT doc_id AS id, true AS doc, text FROM documents
             UNION ALL SELECT item_id, false, text FROM benchmark),
w AS (SELECT id, doc, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM raw WHERE id IS NOT NULL),
s AS (SELECT id, doc, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]
              for i in range(1, len(w) - 3)] END) AS s FROM w),
t AS (SELECT id, doc, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT d.id AS doc_id, b.id AS item_id, any_value(b.n) AS item_shingles, count(*) AS shared
      FROM t d JOIN t b ON d.doc AND NOT b.doc AND d.t = b.t GROUP BY ALL)
SELECT doc_id, item_id, item_shingles::BIGINT AS item_shingles, shared::BIGINT AS shared,
       shared / item_shingles AS containment
FROM p WHERE shared * 100 >= item_shingles * 80
""")
def op9_benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op4_mix_sources")
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mixed_copies(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"))


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def license_sql() -> str:
    rows = ", ".join(f"('{t.label}', {t.phrase}, string_split('{t.text}', ' '), "
                     f"list_filter(string_split('{t.required}', ' '), lambda w: w <> ''))" for t in licenses.TEMPLATES)
    return rf"""
WITH t AS (SELECT label, phrase, seq, required, list_distinct(seq) AS s
           FROM (VALUES {rows}) AS v(label, phrase, seq, required)),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(seq)] = seq)) AS pos
      FROM w JOIN t ON phrase AND list_has_all(w, seq)),
b AS (SELECT doc_id, w[f + 1:f + {licenses.BLOCK}] AS b FROM (
        SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), {licenses.STEP})) AS f FROM w)),
c AS (SELECT doc_id, label, len(list_intersect(list_distinct(b), s)) / len(s) AS share,
             len(list_intersect(list_distinct(b), s)) * 100
               >= len(s) * CASE WHEN len(s) < {licenses.SHORT} THEN 100 ELSE {licenses.CONTAINED} END
             AND list_has_all(b, required) AS fits
      FROM b JOIN t ON NOT phrase),
m AS (SELECT doc_id, label, 1.0::DOUBLE AS share, pos FROM p UNION ALL
      SELECT doc_id, label, share, NULL FROM c WHERE fits),
g AS (SELECT doc_id, count(pos) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
             array_to_string(list_sort(list_distinct(list(label) FILTER (pos IS NOT NULL))), ',') AS base_labels,
             array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score
      FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM w LEFT JOIN g USING (doc_id)"""


@register("op1_license_scan", license_sql())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_summary(table(spark, sf_dir, "documents"))


@register("op5_url_filter")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged_urls(table(spark, sf_dir, "pages"))


@register("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    spans = F.arrays_zip("kinds", "starts", "ends")
    text = lambda a: F.array_join(F.transform(
        a, lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])), ",")
    number = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(text(F.filter(spans, lambda s: s["kinds"] != "format")), 256).alias("base_sha256"),
        text(spans).alias("spans"))


@register("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


@register("op2_repeated_strings")
def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed_repeats(table(spark, sf_dir, "documents"))


MERKLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, doc_id, source,
         concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                   coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text,
         list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
           lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
  FROM documents),
f AS (SELECT pos, doc_id, coalesce('s' || source, '') AS tree,
        sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(t) || ':' || t, '-')) AS judged
      FROM (SELECT *, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t FROM d)),
t AS (SELECT tree, pos, leaf AS digest, 0 AS level, count(*) OVER (PARTITION BY tree) AS n FROM f
      UNION ALL
      SELECT tree, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value(level) + 1, (any_value(n) + 2) // 3
      FROM t WHERE n > 1 GROUP BY tree, pos // 3),
s AS (SELECT tree, digest, level AS height, row_number() OVER (ORDER BY tree) - 1 AS spos FROM t WHERE n = 1),
u AS (SELECT spos AS pos, digest, 0 AS level, count(*) OVER () AS n FROM s
      UNION ALL
      SELECT pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value(level) + 1, (any_value(n) + 2) // 3
      FROM u WHERE n > 1 GROUP BY pos // 3),
runs AS (SELECT tree, level, pos // 3 AS run, list(digest ORDER BY pos) AS nodes FROM t WHERE n > 1 GROUP BY ALL
         UNION ALL SELECT NULL, level, pos // 3, list(digest ORDER BY pos) FROM u WHERE n > 1 GROUP BY ALL),
steps AS (SELECT f.doc_id, t.level, t.pos % 3 AS place, r.nodes
          FROM f JOIN t ON t.tree = f.tree AND t.pos = f.pos // (3 ** t.level)::BIGINT AND t.n > 1
          JOIN runs r ON r.tree = t.tree AND r.level = t.level AND r.run = t.pos // 3
          UNION ALL
          SELECT f.doc_id, s.height + u.level, u.pos % 3, r.nodes
          FROM f JOIN s USING (tree) JOIN u ON u.pos = s.spos // (3 ** u.level)::BIGINT AND u.n > 1
          JOIN runs r ON r.tree IS NULL AND r.level = u.level AND r.run = u.pos // 3),
p AS (SELECT doc_id, sha256(string_agg(array_to_string(list_concat(nodes[:place], nodes[place + 2:]), ''), ''
                            ORDER BY level)) AS proof FROM steps GROUP BY doc_id),
v AS (SELECT doc_id, judged AS value, 0 AS level FROM f
      UNION ALL
      SELECT v.doc_id, sha256(array_to_string(list_concat(nodes[:place], [value], nodes[place + 2:]), '')), v.level + 1
      FROM v JOIN steps x ON x.doc_id = v.doc_id AND x.level = v.level),
top AS (SELECT doc_id, arg_max(value, level) AS folded FROM v GROUP BY doc_id)
SELECT f.doc_id, leaf, s.digest AS subroot, u.digest AS root, coalesce(proof, sha256('')) AS proof_sha256,
       folded AS folded_root, folded = u.digest AS verified
FROM f JOIN s USING (tree) JOIN (SELECT digest FROM u WHERE n = 1) u ON true
LEFT JOIN p ON p.doc_id = f.doc_id JOIN top ON top.doc_id = f.doc_id
"""


@register("op11_merkle_manifest", MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # what a holder shows: texts of every second checksum have lost their line breaks
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), judged={
        "text": F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})


@register("op13_packed_sequences")
def op13_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(table(spark, sf_dir, "documents"), tokenizer_path())


COLLOCATION_SQL = r"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size),
f AS (SELECT lang, phrase, any_value(size) AS size, count(*)::BIGINT AS f FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, size, unnest(range(1, size)) AS k FROM f WHERE size > 1),
s AS (SELECT c.lang, c.phrase, c.size, c.a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM c JOIN t ON t.lang = c.lang
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[:k], ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
kept AS (SELECT * FROM b WHERE cut = 1 AND NOT EXISTS (
           SELECT 1 FROM f x WHERE x.lang = b.lang AND x.size > b.size AND x.f >= b.a
             AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' '))),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""


@register("op12_collocations", COLLOCATION_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))

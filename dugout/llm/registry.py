"""One query per operator over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout.llm.common import table, word_count
from dugout.llm.containment import find_items
from dugout.llm.convtrie import prefix_trie
from dugout.llm.divergence import audit
from dugout.llm import labeller, language, licenses, syncmers, tokenfiles
from dugout.llm.forest import nearest
from dugout.llm.mixing import systematic_mix
from dugout.llm.quotes import link_quotes
from dugout.llm.sharding import shuffle_into_shards
from dugout.llm.simhash import simhash_components
from dugout.sources.scratch import materialize, scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "embeddings"), wanted=F.col("vec_id") % 50 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


@query
def op2_recurrent_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = labeller.fit(pages)
    text = labeller.main_text(pages, model)
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op3_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "containment")


@query
def op4_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are dealt; size and checksum are those of the text that has arrived in its shard."""
    dealt = shuffle_into_shards(table(spark, sf_dir, "documents"), 40)
    text = F.col("row.text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16
    return dealt.select(
        "row.doc_id", size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def held_out() -> Column:
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2


@query
def op5_context_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    target = scratch_dir(spark, "tokens")
    tokenfiles.write(table(spark, sf_dir, "documents"), target, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfiles.read(spark, target).select(
        F.col("key").alias("doc_id"),
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query
def op6_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    return docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), language.identify(docs, model).alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )


@query
def op7_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op8_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


@query
def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_quotes(table(spark, sf_dir, "conversations"))
    return linked.select("row.conv_id", "row.turn", "row.role", *[c for c in linked.columns if c != "row"])


@query
def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    return systematic_mix(materialize(docs, "words"), F.col("words")).select(
        "row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query
def op12_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.printed(F.col("anchors")).alias("fingerprint"),
        syncmers.printed(F.col("edited_anchors")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("id")


@query
def op13_one_hot_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL["op10_systematic_mix"] = r"""
WITH docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS draw
  FROM documents),
classed AS (
  SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 4, 0)) % 8 AS klass FROM docs),
sizes AS (SELECT skey, sum(size)::BIGINT AS source_size FROM classed GROUP BY skey),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS room, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
  FROM sizes),
levels AS (
  SELECT *, room / weight AS fill,
         (total - coalesce(sum(room) OVER (ORDER BY room / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY room / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT skey, source_size,
         CASE WHEN level < fill
              THEN weight * first_value(CASE WHEN level < fill THEN level END IGNORE NULLS)
                   OVER (ORDER BY fill, skey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
              ELSE room END AS target,
         ('0x' || substr(md5('mix/' || skey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM levels),
placed AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY skey ORDER BY klass, draw, size) AS place
  FROM classed JOIN targets USING (skey))
SELECT doc_id, size, source_size, target,
       ((floor(place * rate + start) - floor((place - 1) * rate + start)) * size)::BIGINT AS taken
FROM placed
"""

_TEMPLATES = ", ".join(
    f"({n}, {t.label!r}, {str(t.base).lower()}, {len(t.text.split()) - 1}, {i}, {a!r}, {b!r})"
    for n, i, a, b in licenses.pairs(licenses.TEMPLATES)
    for t in [licenses.TEMPLATES[n]]
)
SQL["op8_diagonal_voting"] = rf"""
WITH worded AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
grams(template, label, base, pairs, place, a, b) AS (VALUES {_TEMPLATES}),
placed AS (
  SELECT r, unnest(words) AS a, unnest(words[2:]) AS b, generate_subscripts(words, 1) - 1 AS pos FROM worded),
votes AS (
  SELECT r, template, any_value(label) AS label, any_value(base) AS base, any_value(pairs) AS pairs, pos - place AS diagonal,
         bit_or(1::BIGINT << place) AS bits, min(pos) AS lo, max(pos) AS hi
  FROM placed JOIN grams USING (a, b) GROUP BY r, template, pos - place),
steps AS (
  SELECT *, CASE WHEN NOT base AND diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {licenses.SLACK}
            THEN 0 ELSE 1 END AS step
  FROM votes WHERE base OR bit_count(bits) >= 2),
grouped AS (
  SELECT *, sum(step) OVER (PARTITION BY r, template ORDER BY diagonal) AS g FROM steps),
spans AS (
  SELECT r, any_value(label) AS label, any_value(base) AS base, any_value(pairs) AS pairs,
         bit_count(bit_or(bits)) AS held, min(lo) AS lo, max(hi) AS hi
  FROM grouped GROUP BY r, template, g),
kept AS (
  SELECT *, held / pairs::DOUBLE AS share FROM spans
  WHERE (base AND held = pairs)
     OR (NOT base AND held / pairs::DOUBLE >= {licenses.MIN_SHARE} AND hi - lo + 2 <= (pairs + 1) * {licenses.STRETCH})),
found AS (
  SELECT r, count(*) FILTER (WHERE base) AS n_base, min(lo) FILTER (WHERE base) AS first_word,
         max(lo) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM kept GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM worded LEFT JOIN found USING (r)
"""

SQL["op9_quotation_linking"] = r"""
WITH RECURSIVE numbered AS (
  SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS id, coalesce(conv_id::VARCHAR, '') AS conv,
         coalesce(turn, -4611686018427387904) AS at_turn FROM conversations),
split AS (
  SELECT id, conv, at_turn, unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r')) AS line,
         generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r'), 1) AS n FROM numbered),
marked AS (
  SELECT *, regexp_extract(line, '^[ \t]*((?:>[ \t]?)*)', 1) AS marks FROM split),
lines AS (
  SELECT id, conv, at_turn, n, length(regexp_replace(marks, '[^>]', '', 'g')) AS level,
         CASE WHEN marks = '' THEN line ELSE regexp_replace(line, '^[ \t]*((?:>[ \t]?)*)', '') END AS body FROM marked),
shapes AS (
  SELECT id, max(level)::INTEGER AS quote_levels, (count(*) FILTER (WHERE level > 0))::INTEGER AS quoted_lines FROM lines GROUP BY id),
levels AS (
  SELECT id, unnest(range(0, quote_levels + 1)) AS level FROM shapes),
texts AS (
  SELECT l.id, v.level, any_value(conv) AS conv, any_value(at_turn) AS at_turn,
         string_agg(CASE WHEN l.level = v.level THEN body ELSE '' END, chr(10) ORDER BY n) AS body
  FROM lines l JOIN levels v USING (id) GROUP BY l.id, v.level),
parts AS (
  SELECT id, level, conv, at_turn, unnest(list_concat([body], regexp_split_to_array(body, '\n[ \t]*(?:\n[ \t]*)+'),
         regexp_split_to_array(body, '\n'))) AS part FROM texts),
passages AS (
  SELECT DISTINCT id, level, conv, at_turn, trim(regexp_replace(lower(part), '[^\p{L}\p{N}]+', ' ', 'g')) AS passage FROM parts),
firsts AS (
  SELECT conv, passage, min((at_turn, id)) AS first FROM passages WHERE level = 0 AND passage <> '' GROUP BY conv, passage),
matches AS (
  SELECT p.id, p.level, f.first FROM passages p JOIN firsts f USING (conv, passage)
  WHERE p.level > 0 AND f.first < (p.at_turn, p.id)),
parents AS (
  SELECT id, max((-level, first))[2] AS parent FROM matches GROUP BY id),
climb AS (
  SELECT id, parent[2] AS root, 1::BIGINT AS depth FROM parents
  UNION ALL SELECT c.id, p.parent[2], c.depth + 1 FROM climb c JOIN parents p ON p.id = c.root),
tops AS (
  SELECT id, max((depth, root))[2] AS root, max(depth) AS depth FROM climb GROUP BY id),
threads AS (
  SELECT m.*, p.parent[1] AS parent_turn, coalesce(r.at_turn, m.at_turn) AS thread_at, coalesce(t.root, m.id) AS root,
         coalesce(t.depth, 0)::BIGINT AS depth
  FROM numbered m LEFT JOIN parents p USING (id) LEFT JOIN tops t USING (id) LEFT JOIN numbered r ON r.id = t.root)
SELECT conv_id, turn, role,
       regexp_replace(regexp_replace(x.body, '\n[ \t]*(?:\n[ \t]*)+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text,
       quote_levels, quoted_lines, parent_turn::BIGINT AS parent_turn,
       CASE WHEN thread_at <> -4611686018427387904 THEN thread_at END::BIGINT AS thread_turn, depth,
       (row_number() OVER (PARTITION BY t.conv, conv_id IS NULL ORDER BY thread_at, root, t.at_turn, t.id) - 1)::BIGINT AS position
FROM threads t JOIN shapes USING (id) JOIN texts x ON x.id = t.id AND x.level = 0
"""

SQL["op11_prefix_trie"] = r"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
-- CRC-32 of the decimal number: each byte is added, then eight steps (-1) shift a bit out.
convs AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
           lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END),
         4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT v.c, t.place, 0 AS own, t.role, t.text FROM convs v JOIN turns t ON t.c = v.base AND t.place <= v.h
  UNION ALL SELECT v.c, t.place, 1, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.place > v.h),
placed AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, place) AS d, md5(length(role)::VARCHAR || ':' || role || text) AS turn,
         strlen(text)::BIGINT AS size FROM rebuilt),
walks AS (
  SELECT c, d, size, md5(string_agg(turn, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS id,
         d = count(*) OVER (PARTITION BY c) AS ends FROM placed
  UNION ALL SELECT c, 0, 0, '', c NOT IN (SELECT c FROM placed) FROM convs),
linked AS (
  SELECT *, lag(id) OVER (PARTITION BY c ORDER BY d) AS parent FROM walks),
nodes AS (
  SELECT id, d, any_value(parent) AS parent, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(size) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends
  FROM linked GROUP BY id, d),
kids AS (SELECT parent AS id, count(*) AS kids FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT w.id, w.d, sum(x.saved) AS saved, count(*) FILTER (WHERE x.leaf) AS leaves
  FROM (SELECT nodes.*, id NOT IN (SELECT id FROM kids) AS leaf FROM nodes) x JOIN linked w ON w.c = x.c AND w.d <= x.d GROUP BY w.id, w.d)
SELECT nodes.c AS conv_id, nodes.d::BIGINT AS depth, p.c AS parent_conv_id, nodes.n::BIGINT AS n_convs,
       coalesce(kids.kids, 0)::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens,
       nodes.ends AS ends_sha256
FROM nodes JOIN below ON below.id = nodes.id AND below.d = nodes.d LEFT JOIN kids ON kids.id = nodes.id
LEFT JOIN nodes p ON p.id = nodes.parent AND p.d = nodes.d - 1
"""

SQL["op13_one_hot_levels"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
used AS (SELECT doc, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n_lang FROM used GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS n_all FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
  SELECT s.lang, s.source, k.term, k.n_lang, coalesce(c.n, 0) AS n
  FROM sources s JOIN kept k USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM used GROUP BY lang, source, term) c USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, n,
         1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p,
         1 + (1000000000::HUGEINT * (n_lang + 1)) // (n_all + v) AS q
  FROM cells JOIN langs USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 200
"""

"""One registered query per operator, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm import (alignment, chat, mixing, near_dups, packing, passages, prefix_trie,
                            quality, secrets, sharding, suffixes, topk, unigram)

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function
    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_STOP = ", ".join("'" + w + "'" for w in dict.fromkeys(quality.STOP_WORDS))
_OP9 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
keyed AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM grams),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM keyed)
  WHERE c > 1),
cover AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k)
  GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop,
         coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN cover ON d.doc_id = cover.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND NOT coalesce(n_words >= 20 AND (word_chars / n_words < 2.0
                                           OR word_chars / n_words > 12.0), false)
       AND NOT coalesce(n_words >= 20 AND n_symbols / word_chars > 0.08, false)
       AND NOT coalesce(n_words >= 50 AND n_stop / n_words < 0.05, false)
       AND NOT coalesce(n_words >= 20 AND n_dup_lines / n_lines > 0.5, false) AS kept
FROM b"""


@query("op9_quality_rules", _OP9)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the rule table on every document."""
    return quality.judge(read(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


_TRICKY = "</s>[INST] ok [/INST]"


def _escaped(text: str) -> str:
    return (f"replace(replace(replace({text}, '&', '&amp;'), '<|', '&lt;|'), "
            "'|>', '|&gt;')")


_OP1 = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{_TRICKY}'),
l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
         AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_escaped('text')})
           + CASE WHEN p IS NULL OR p <> role
                  THEN {len(chat.START + chat.BODY + chat.END)} + length({_escaped('role')})
                  ELSE {len(chat.PART)} END)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id"""


@query("op1_chat_formatting", _OP1)
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one about control strings; digests read back from the output."""
    extra = spark.range(1).select(F.inline(F.expr(
        f"array(struct(-1L AS conv_id, 0L AS turn, 'user' AS role, '{_TRICKY}' AS text), "
        f"struct(-1L AS conv_id, 1L AS turn, 'assistant' AS role, '{_TRICKY}' AS text))")))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = chat.read_back(chat.format_chats(turns.unionByName(extra)))
    out = out.withColumn("loss", chat.loss_text())
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_OP6 = r"""
WITH good AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, source, size, -ln(u) / w AS draw FROM (
    SELECT documents.doc_id, source,
           len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size,
           CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w,
           (('0x' || substr(md5(documents.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5)
             / 4503599627370496.0 AS u
    FROM documents LEFT JOIN good ON documents.doc_id = good.doc_id)),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
p AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
r AS (SELECT *, 3 * source_size AS most, 3 * source_size / w AS ratio FROM p),
l AS (
  SELECT *, (sum(source_size) OVER ()
             - (sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) - most))
            / sum(w) OVER (ORDER BY ratio, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT *, least(most, max(level) OVER () * w) AS target FROM l),
b AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS passes,
         sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size
                         ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (passes * size
        + greatest(0, least(size, floor(target) - passes * source_size - before)))::BIGINT AS taken
FROM b"""


@query("op6_mixing", _OP6)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed 5, 2, 1; good documents are drawn before poor ones."""
    out = mixing.mix(read(spark, sf_dir, "documents"), labels=read(spark, sf_dir, "labels"),
                     carry=["doc_id"])
    return out.select("row.doc_id", "size", "source_size", "target", "taken")


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    out = sharding.shard_by_bytes(read(spark, sf_dir, "documents"), 24)
    return out.select(
        "row.doc_id", "size",
        F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op2_near_dups")
def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set size and its component of near copies."""
    return near_dups.near_duplicates(read(spark, sf_dir, "documents"))


_OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h,
                  octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 199)) AS i, h FROM d WHERE n >= 200),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM k)
      WHERE c > 1),
s AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true)
             AS first FROM r),
g AS (SELECT doc_id, i, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM spans),
parts AS (SELECT e.doc_id, string_agg(substr(h, 2 * coalesce(p, 0) + 1, 2 * (a - coalesce(p, 0))),
                                      '' ORDER BY a) AS kept, max(b) AS last,
                 sum(b - a) AS n_removed, count(*) AS n_spans
          FROM e JOIN d ON e.doc_id = d.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN parts ON d.doc_id = parts.doc_id"""


@query("op3_suffix_dedup", _OP3)
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of its repeated 200-byte strings."""
    out = suffixes.remove_repeats(read(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")


_OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
a AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS m FROM a),
r AS (SELECT doc_id, i FROM (
        SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS n FROM k)
      WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS i FROM r),
each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT each.doc_id, string_agg(x, ' ' ORDER BY each.i) AS t, count(*) AS n
         FROM each ANTI JOIN c ON each.doc_id = c.doc_id AND each.i = c.i GROUP BY each.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""


@query("op7_passage_dedup", _OP7)
def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word passages that came before."""
    out = passages.remove_passages(read(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as windows of at most 2048 ids; one row per piece."""
    import public_tokenizers
    out = packing.pack(read(spark, sf_dir, "documents"),
                       public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                      "doc_tokens", "sequence_id", "offset")


_OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL)) = 0
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_dot_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5"""


@query("op4_exact_top_k", _OP4)
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of every fiftieth vector."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and unigram tokens of every document."""
    import public_tokenizers
    out = unigram.count_tokens(read(spark, sf_dir, "documents"),
                               public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.withColumnRenamed("id", "doc_id")


#: crc32 of a conversation's decimal id, bit by bit
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT],
        list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)),
    4294967295::UBIGINT)"""

_OP11 = f"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, ({_CRC} % 6)::BIGINT AS h
      FROM (SELECT DISTINCT conv_id FROM o)),
r AS (
  SELECT c.conv_id, p, role, text FROM c JOIN o ON o.conv_id = c.base AND p <= h
  UNION ALL SELECT o.conv_id, p + 6, role, text FROM o JOIN c ON o.conv_id = c.conv_id AND p > h),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS depth,
             count(*) OVER (PARTITION BY conv_id) AS n,
             list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY p) AS path FROM r),
k AS (
  SELECT conv_id, depth, n, length(text) AS chars, md5(path::VARCHAR) AS node,
         coalesce(lag(md5(path::VARCHAR)) OVER (PARTITION BY conv_id ORDER BY depth), '') AS up FROM t
  UNION ALL
  SELECT c.conv_id, 0, coalesce(max(n), 0), 0, '', NULL FROM c LEFT JOIN t ON t.conv_id = c.conv_id
  GROUP BY c.conv_id),
nodes AS (
  SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), ''))
           AS ends_sha256 FROM k GROUP BY node, depth),
kids AS (SELECT up AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes
         WHERE depth > 0 GROUP BY ALL),
-- a member saves its text at each node that a smaller member has too; a childless node counts
-- for its smallest member
v AS (
  SELECT k.*, CASE WHEN k.conv_id = nodes.conv_id THEN 0 ELSE chars END AS saved,
         (k.conv_id = nodes.conv_id AND n_children IS NULL)::INT AS leaf
  FROM k JOIN nodes USING (node, depth) LEFT JOIN kids USING (node, depth)),
s AS (
  SELECT node, depth,
         sum(saved) OVER (PARTITION BY conv_id ORDER BY depth DESC) AS saved,
         sum(leaf) OVER (PARTITION BY conv_id ORDER BY depth DESC) AS leaves FROM v)
SELECT nodes.conv_id, nodes.depth, parents.conv_id AS parent_conv_id, nodes.n_convs,
       coalesce(n_children, 0) AS n_children, sum(leaves)::BIGINT AS n_leaves,
       sum(saved)::BIGINT AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN s USING (node, depth) LEFT JOIN kids USING (node, depth)
LEFT JOIN nodes parents ON parents.node = nodes.up AND parents.depth = nodes.depth - 1
GROUP BY ALL"""


@query("op11_prefix_trie", _OP11)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie over all conversations with borrowed beginnings."""
    turns = read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "conv")
    return prefix_trie.prefix_trie(*prefix_trie.share_heads(turns))


def _found(kind: int, pattern: str, least: int = 0) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT row, {kind} AS kind, e - length(m) AS a, e, CASE WHEN {kind} = 0
           THEN regexp_extract(m, '{pattern}', {2 if kind == 0 else 0}) ELSE m END AS value
  FROM (SELECT row, m, sum(length(g) + length(m)) OVER (PARTITION BY row ORDER BY i) AS e
        FROM (SELECT row, unnest(regexp_extract_all(text, '{pattern}', 0)) AS m,
                     unnest(string_split_regex(text, '{pattern}')) AS g,
                     generate_subscripts(string_split_regex(text, '{pattern}'), 1) AS i FROM d)
        WHERE m IS NOT NULL)
  WHERE {kind} > 0 OR length(value) >= {least}"""


_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, lang, coalesce(text, '') AS text
           FROM documents),
f AS ({" UNION ALL ".join([_found(0, secrets.ASSIGN, secrets.ASSIGN_LEAST),
                           _found(1, secrets.ACCESS), _found(2, secrets.HEX),
                           _found(3, secrets.OTHER)])}),
v AS (
  SELECT DISTINCT row, e - length(value) AS a, e, value FROM f
  WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND len(list_distinct(string_split(value, ''))) >= 6
    AND (kind < 3 OR regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]'))),
o AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners
      FROM v JOIN d USING (row) GROUP BY value),
live AS (SELECT row, 3 AS kind, a, e FROM v JOIN o USING (value) WHERE owners = 1),
base AS (SELECT row, kind, a, e FROM f WHERE kind < 3),
named AS (
  SELECT row, kind, a, e, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || a::BIGINT::VARCHAR
           || ':' || e::BIGINT::VARCHAR AS s
  FROM (FROM base UNION ALL FROM live)),
g AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
         count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_live,
         string_agg(s, ',' ORDER BY a, kind, e) FILTER (kind < 3) AS base,
         string_agg(s, ',' ORDER BY a, kind, e) AS spans FROM named GROUP BY row),
x AS (SELECT row, count(*) AS n_example FROM v JOIN o USING (value)
      WHERE owners >= {secrets.EXAMPLE_OWNERS} GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (row) LEFT JOIN x USING (row)"""


@query("op12_secret_scans", _OP12)
def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials in all documents; a source is an owner, its texts of a language a repository."""
    docs = read(spark, sf_dir, "documents")
    out = secrets.find_secrets(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"),
                               carry=["doc_id"])

    def many(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "row.doc_id", *[many(k).alias(f"n_{name}") for k, name in
                        enumerate(secrets.KINDS[:secrets.LIVE])],
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"), "n_live", "n_example")


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers over all documents, linked where they end together."""
    import public_tokenizers
    out = alignment.align_tokenizers(
        read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")

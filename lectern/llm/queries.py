"""The registered queries of this folder: name -> (query, SQL twin or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.llm import chat, chosen_path, context_tree, fill_middle, fuzzy_lines, merkle, mixing, packing, quality, repeats, spotsigs, vp_simhash
from lectern.llm.shared import read

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


def tokenizer_path() -> str:
    """The vocabulary file of the production parameters."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_quality_rules")
def op1(spark, sf):
    scored = quality.score_statistics(read(spark, sf, "documents"), read(spark, sf, "labels"))
    return scored.select("doc_id", *quality.BASE, "base_failed", "kept", "score")


#: Roles, escapes and marks of chat.TEMPLATE, in SQL.
OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|\[SYS\]|\[/SYS\]|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[TEXT\]|\[/ROLE\]'))
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
      ELSE 23 + length(role) + len(regexp_extract_all(role, '\\|\[SYS\]|\[/SYS\]|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[TEXT\]|\[/ROLE\]')) END AS formatted,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(formatted)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' ELSE false END AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM f GROUP BY conv_id
"""


@query("op2_chat_format", OP2_SQL)
def op2(spark, sf):
    talks = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return chat.read_turns(chat.format_turns(talks.unionByName(own)))


@query("op4_mix_sources")
def op4(spark, sf):
    planned = mixing.plan_mix(read(spark, sf, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return planned.select("doc_id", "size", "source_size", "target", taken, "copies", "source")


@query("op5_pack_sequences")
def op5(spark, sf):
    return packing.packed_sequences(read(spark, sf, "documents"), tokenizer_path())


@query("op8_best_two_fit")
def op8(spark, sf):
    packed = packing.pack_documents(read(spark, sf, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op9_context_tree")
def op9(spark, sf):
    return context_tree.score_texts(read(spark, sf, "documents"), context_tree.held_out("doc_id"))


@query("op10_remove_repeats")
def op10(spark, sf):
    left = repeats.remove_repeats(read(spark, sf, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
), u AS (
  SELECT t, min(doc_id) AS rep, list_distinct(CASE WHEN len(any_value(w)) = 0 THEN []::VARCHAR[]
    WHEN len(any_value(w)) < 5 THEN [array_to_string(any_value(w), ' ')]
    ELSE list_transform(range(1, len(any_value(w)) - 3), lambda i: array_to_string(any_value(w)[i:i + 4], ' ')) END) AS g
  FROM d GROUP BY t
), x AS (SELECT rep, len(g) AS n, unnest(g) AS h FROM u),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) + any_value(b.n) - count(*) AS n, count(*) AS c FROM x a JOIN x b USING (h) WHERE a.rep <> b.rep GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 5 * c >= 4 * n),
r AS (SELECT rep AS node, rep AS root FROM u UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, rep AS text_class
FROM d JOIN u USING (t) JOIN (SELECT node AS rep, min(root) AS class_id FROM r GROUP BY 1) USING (rep)
LEFT JOIN (SELECT a AS rep, count(*) AS n_links FROM l GROUP BY 1) USING (rep)
"""


@query("op7_chosen_path_join", OP7_SQL)
def op7(spark, sf):
    return chosen_path.jaccard_classes(read(spark, sf, "documents")).drop("_row")


@query("op6_spot_signatures")
def op6(spark, sf):
    return spotsigs.edited_fingerprints(read(spark, sf, "documents"))


@query("op3_fuzzy_lines")
def op3(spark, sf):
    return fuzzy_lines.line_report(read(spark, sf, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), h AS (
  SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda k: list_reduce(list_transform(string_split(substr(x, k, 8), ''), lambda c: strpos('0123456789abcdef', c)::BIGINT - 1), lambda a, b: a * 16 + b)) AS r
  FROM d
), c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS lo, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM c
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM p
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(output) AS output_sha256, length(output) AS output_chars, sha256(t) AS restored_sha256
FROM o
"""


@query("op11_fill_middle", OP11_SQL)
def op11(spark, sf):
    return fill_middle.digests(read(spark, sf, "documents"))


@query("op12_vp_simhash")
def op12(spark, sf):
    return vp_simhash.components(read(spark, sf, "documents"))


#: CRC-32 by its bits, the trees level by level, then each leaf's way up.
OP13_SQL = r"""
WITH RECURSIVE k AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS g,
    (SELECT list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [256 + ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))),
      lambda x, s: CASE WHEN s >= 256 THEN xor(x, s - 256) ELSE xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END) END)) AS crc,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    n_chars, coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
  FROM documents
), l AS (
  SELECT *, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail)
      ELSE sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) END AS changed
  FROM k
), p AS (
  SELECT doc_id, g, leaf, changed, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l
), t AS (
  SELECT g, 0 AS level, i, n, leaf AS h FROM p
  UNION ALL SELECT g, level + 1, i // 2, any_value(n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, level, i // 2
), s AS (SELECT g, h AS subroot, level AS height, row_number() OVER (ORDER BY g) - 1 AS j, count(*) OVER () AS m FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, j, m, subroot AS h FROM s
  UNION ALL SELECT level + 1, j // 2, any_value(m + 1) // 2, sha256(string_agg(h, '' ORDER BY j)) FROM u WHERE m > 1 GROUP BY level, j // 2
), r AS (SELECT h AS root, level AS depth FROM u WHERE m = 1),
f AS (
  SELECT doc_id, leaf, changed AS h, '' AS proof, g, i, 0 AS level, subroot, height, j, root, depth FROM p JOIN s USING (g), r
  UNION ALL
  SELECT f.doc_id, f.leaf,
    CASE WHEN f.level < f.height THEN sha256(CASE WHEN f.i % 2 = 1 THEN a.h || f.h ELSE f.h || coalesce(a.h, '') END)
      ELSE sha256(CASE WHEN f.j % 2 = 1 THEN b.h || f.h ELSE f.h || coalesce(b.h, '') END) END,
    f.proof || CASE WHEN f.level < f.height THEN coalesce(a.h, '') ELSE coalesce(b.h, '') END,
    f.g, CASE WHEN f.level < f.height THEN f.i // 2 ELSE f.i END, f.level + 1, f.subroot, f.height,
    CASE WHEN f.level < f.height THEN f.j ELSE f.j // 2 END, f.root, f.depth
  FROM f LEFT JOIN t a ON a.g = f.g AND a.level = f.level AND f.level < f.height AND a.i = xor(f.i, 1)
    LEFT JOIN u b ON b.level = f.level - f.height AND b.j = xor(f.j, 1)
  WHERE f.level < f.height + f.depth
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM f WHERE level = height + depth
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13(spark, sf):
    return merkle.audit(read(spark, sf, "documents"))

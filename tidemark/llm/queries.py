"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chat_format,
    collocations,
    decontaminate,
    exact_dedup,
    language_id,
    lattice_lm,
    license_scan,
    line_templates,
    merkle_manifest,
    piece_codec,
    simhash,
    suffix_dedup,
    url_filter,
)
from tidemark.llm.shared import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODEL_FILE = "piece_bpe_32k.model"


def _register(run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[run.__name__] = run
    if sql:
        ORACLES[run.__name__] = sql


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicates(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


_register(
    op1_exact_dedup,
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)


URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(documents(spark, sf_dir, "pages"), URL_RULES)


_register(
    op2_url_filter,
    r"""
    WITH RECURSIVE parsed AS (
        SELECT page_id, url,
               translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
               regexp_extract(coalesce(url, ''), '(?s)^[^?#]*(\?[^#]*)', 1) AS query,
               regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
                              '(?is)\bhref\s*=\s*["'']([a-z]+://[^"'']*)', 1) AS link
        FROM pages
    ), rules(verdict, rhost, rpath) AS (
        VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
               ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
    ), keyed AS (
        SELECT page_id, host, path, host || path || query AS key,
               translate(regexp_extract(link, '(?s)^.*?://([^/?#]*)', 1),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                 || regexp_extract(link, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS target
        FROM parsed
    ), edges AS (
        SELECT key AS u, target AS v FROM keyed WHERE target <> '' AND target <> key
        UNION SELECT target, key FROM keyed WHERE target <> '' AND target <> key
    ), reach AS (
        SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u
    ), own AS (
        SELECT name, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
        FROM (SELECT DISTINCT host || path AS name, host, path FROM keyed
              UNION SELECT DISTINCT regexp_extract(u, '^[^?]*'), regexp_extract(u, '^[^/?]*'), regexp_extract(u, '^[^/?]*([^?]*)', 1) FROM edges) n
        JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
        GROUP BY name
    ), carried AS (
        SELECT u, min(least(u, v)) AS alias_of, coalesce(bool_or(o.verdict = 'allow'), false) AS allowed,
               coalesce(bool_or(o.verdict = 'block'), false) AS blocked
        FROM reach LEFT JOIN own o ON o.name = regexp_extract(v, '^[^?]*') GROUP BY u
    )
    SELECT k.page_id, k.host, k.path, o.rule,
           coalesce(o.verdict, CASE WHEN c.allowed THEN 'allow' WHEN c.blocked THEN 'block' END, 'allow') AS verdict,
           c.alias_of
    FROM keyed k LEFT JOIN own o ON o.name = k.host || k.path LEFT JOIN carried c ON c.u = k.key
    """,
)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


_register(
    op3_decontamination,
    r"""
    WITH texts AS (
        SELECT 'd' AS kind, doc_id AS id, text FROM documents
        UNION ALL SELECT 'i', item_id, text FROM benchmark
    ), worded AS (
        SELECT kind, id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2f\x3a-\x5e\x60\x7b-\x7f]+') AS w FROM texts
    ), shingled AS (
        SELECT DISTINCT kind, id, w[k:k + 4] AS s
        FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS k FROM worded)
    ), items AS (
        SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS item_shingles
        FROM shingled WHERE kind = 'i'
    )
    SELECT d.id AS doc_id, i.item_id, i.item_shingles, count(*) AS shared_shingles,
           count(*)::DOUBLE / i.item_shingles AS containment
    FROM shingled d JOIN items i ON d.s = i.s
    WHERE d.kind = 'd'
    GROUP BY d.id, i.item_id, i.item_shingles
    HAVING count(*) >= 0.8 * i.item_shingles - 1e-9
    """,
)


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_codec.read_model(piece_codec.model_path(MODEL_FILE))
    return lattice_lm.score_documents(documents(spark, sf_dir), model).withColumnRenamed("id", "doc_id")


_register(op4_lattice_lm)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame(
        [(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"
    )
    given = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = chat_format.format_conversations(given.unionByName(added))
    turns = F.transform(
        "turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))
    )
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_register(
    op5_chat_format,
    r"""
    WITH given AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ), written AS (
        SELECT *, CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System'
                       WHEN 'tool' THEN 'Tool' ELSE '=' || url_encode(role) END AS name,
               CASE WHEN regexp_matches(text, '\\(###|</turn>)') OR contains(text || chr(10), chr(10) || '</turn>' || chr(10))
                    THEN regexp_replace(text, '(\\*(?:###|</turn>))', '\\\1', 'g') ELSE text END AS shown
        FROM given
    ), joined AS (
        SELECT conv_id, count(*) AS n_turns,
               string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
               coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
               sum(length('### ' || name || ': ' || shown) + 9)::BIGINT AS formatted_chars
        FROM written GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
           sha256(loss) AS loss_sha256, formatted_chars
    FROM joined
    """,
)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_codec.read_model(piece_codec.model_path(MODEL_FILE))
    coded = piece_codec.encode_decode(documents(spark, sf_dir).select("doc_id", "text"), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


_register(op6_sentencepiece)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


_register(op7_simhash)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    judged = language_id.identify(docs.select("doc_id", "text"), language_id.train_on_rest(docs))
    return judged.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


_register(op8_language_id)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


_register(op9_suffix_dedup)


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"), min_tokens=1)
    return found.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


_register(op10_line_templates)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


_register(
    op11_collocations,
    r"""
    WITH texts AS (
        SELECT coalesce(lang, 'und') AS lang, doc_id,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents
    ), pieces AS (
        SELECT lang, doc_id, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
    ), worded AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
    ), grams AS (
        SELECT lang, phrase, count(*) AS f
        FROM (SELECT lang, unnest(flatten(list_transform(range(1, len(w) + 1),
                     lambda i: list_transform(range(i, least(i + 3, len(w)) + 1), lambda j: array_to_string(w[i:j], ' '))))) AS phrase
              FROM worded)
        GROUP BY ALL
    ), totals AS (
        SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
    ), candidates AS (
        SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE f >= 30 AND contains(phrase, ' ')
    ), cuts AS (
        SELECT lang, phrase, a, w, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
        FROM (SELECT *, unnest(range(1, len(w))) AS k FROM candidates)
    ), weighed AS (
        SELECT c.lang, c.phrase, c.a, c.w, c.k, x.f AS l, y.f AS r, (c.a::HUGEINT * 2000000) // (x.f::HUGEINT + y.f) AS score
        FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.head JOIN grams y ON y.lang = c.lang AND y.phrase = c.rest
    ), weakest AS (
        SELECT * FROM weighed QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ), kept AS (
        SELECT * FROM weakest s
        WHERE NOT EXISTS (
            SELECT 1 FROM candidates t
            WHERE t.lang = s.lang AND len(t.w) > len(s.w) AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')
              AND 100 * t.a::HUGEINT >= 80 * s.a::HUGEINT)
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
           phrase, a, l, r, n, score::BIGINT AS score
    FROM kept JOIN totals USING (lang)
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
    """,
)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _license_sql() -> str:
    """Every block against every template by counting, and every place against every phrase."""
    templates = ", ".join(
        f"('{label}', {license_scan.step_of(len(w))}, {_sql_list(sorted(set(w)))})"
        for label, w in ((label, license_scan.plain_words(text)) for label, text in license_scan.TEMPLATES)
    )
    phrases = ", ".join(f"('{label}', {_sql_list(p.split(' '))})" for p, label in license_scan.PHRASES.items())
    return rf"""
    WITH worded AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), templates(label, step, t) AS (VALUES {templates}
    ), phrases(label, p) AS (VALUES {phrases}
    ), places AS (
        SELECT doc_id, label, k - 1 AS place
        FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM worded) JOIN phrases ON w[k] = p[1] AND w[k:k + len(p) - 1] = p
    ), blocks AS (
        SELECT doc_id, step, b, w[b * step + 1:b * step + 2 * step] AS w
        FROM (SELECT doc_id, w, step, unnest(range(0, greatest((len(w) - 1) // step + 1, 1))) AS b
              FROM worded, (SELECT DISTINCT step FROM templates))
    ), held AS (
        SELECT doc_id, label, len(list_intersect(t, w)) AS n, len(t) AS size
        FROM blocks JOIN templates USING (step)
    ), hits AS (
        SELECT doc_id, label, max(n / size) AS c FROM held WHERE 100 * n >= {license_scan.PERCENT} * size GROUP BY doc_id, label
    ), base AS (
        SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS labels
        FROM places GROUP BY doc_id
    ), more AS (
        SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best FROM hits GROUP BY doc_id
    )
    SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
           coalesce(array_to_string(base.labels, ','), '') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
           CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
    FROM worded w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
    """


_register(op12_license_scan, _license_sql())


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle_manifest.verify(documents(spark, sf_dir))
    text = lambda name: F.lower(F.hex(name))
    return found.select(
        F.col("id").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        text("proof").alias("proof_sha256"), text("folded_root").alias("folded_root"), "verified",
    )


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field_sql(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_register(
    op13_merkle_manifest,
    f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
               {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS changed,
               xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                   lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT) AS crc
        FROM documents
    ), placed AS (
        SELECT *, coalesce('=' || source, '-') AS tree,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
    ), levels AS (
        SELECT tree, 0 AS lev, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY tree
        UNION ALL
        SELECT tree, lev + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], '')))
        FROM levels WHERE len(nodes) > 1
    ), subroots AS (
        SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM levels WHERE len(nodes) = 1
    ), upper AS (
        SELECT 0 AS lev, list(subroot ORDER BY pos) AS nodes FROM subroots
        UNION ALL
        SELECT lev + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], '')))
        FROM upper WHERE len(nodes) > 1
    ), folded AS (
        SELECT doc_id, tree, 0 AS lev, pos, CASE WHEN crc % 5 = 0 THEN changed ELSE leaf END AS digest, '' AS proof FROM placed
        UNION ALL
        SELECT doc_id, tree, lev + 1, pos // 16,
               sha256(array_to_string(nodes[pos // 16 * 16 + 1:pos], '') || digest || array_to_string(nodes[pos + 2:pos // 16 * 16 + 16], '')),
               proof || array_to_string(nodes[pos // 16 * 16 + 1:pos], '') || array_to_string(nodes[pos + 2:pos // 16 * 16 + 16], '')
        FROM folded JOIN levels USING (tree, lev) WHERE len(nodes) > 1
    ), raised AS (
        SELECT doc_id, 0 AS lev, s.pos, digest, proof
        FROM folded JOIN levels USING (tree, lev) JOIN subroots s USING (tree) WHERE len(nodes) = 1
        UNION ALL
        SELECT doc_id, lev + 1, pos // 16,
               sha256(array_to_string(nodes[pos // 16 * 16 + 1:pos], '') || digest || array_to_string(nodes[pos + 2:pos // 16 * 16 + 16], '')),
               proof || array_to_string(nodes[pos // 16 * 16 + 1:pos], '') || array_to_string(nodes[pos + 2:pos // 16 * 16 + 16], '')
        FROM raised JOIN upper USING (lev) WHERE len(nodes) > 1
    ), top AS (
        SELECT lev, nodes[1] AS root FROM upper WHERE len(nodes) = 1
    )
    SELECT p.doc_id, p.leaf, s.subroot, t.root, sha256(r.proof) AS proof_sha256, r.digest AS folded_root, r.digest = t.root AS verified
    FROM placed p JOIN subroots s USING (tree) JOIN raised r ON r.doc_id = p.doc_id JOIN top t ON t.lev = r.lev
    """,
)

"""The registered queries over the given tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm import ann_additive, exact_dedup, hard_negatives, license_scan, line_dedup, merkle, mixing, packing, quality_gam, quality_rules, sharding, simhash, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.find_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), 24)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix_documents(docs).select("doc_id", "mix_domain", "lang", "source", "mix_tokens", "mix_epoch")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_ann_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_additive.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_pages(_table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.count_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path of their own: source and language are their directories."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")), "doc_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op12_hard_negatives": op12_hard_negatives,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op13_quality_rules": op13_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op7_license_scan": op7_license_scan,
    "op1_ann_additive": op1_ann_additive,
    "op3_quality_gam": op3_quality_gam,
    "op5_url_filters": op5_url_filters,
    "op4_mixing": op4_mixing,
    "op6_packing": op6_packing,
    "op8_simhash": op8_simhash,
    "op10_sharding": op10_sharding,
    "op9_exact_dedup": op9_exact_dedup,
}

def _rules_sql() -> str:
    fences = []
    for name, (least, both) in quality_rules.MEASURES.items():
        reach = quality_rules.REACH
        fences.append(f"max(CASE WHEN measure = '{name}' THEN {f'q25 - {reach} * greatest(q50 - q25, {least})' if both else '0'} END) AS {name}_low")
        fences.append(f"max(CASE WHEN measure = '{name}' THEN q75 + {reach} * greatest(q75 - q50, {least}) END) AS {name}_high")
    of = lambda level: f"""
        SELECT lang, source, max(n) AS n, {', '.join(fences)} FROM (
          SELECT lang, source, measure, max(n) AS n, min(CASE WHEN 100 * upto >= 25 * n THEN bucket END) AS q25,
                 min(CASE WHEN 100 * upto >= 50 * n THEN bucket END) AS q50, min(CASE WHEN 100 * upto >= 75 * n THEN bucket END) AS q75
          FROM (SELECT *, sum(n1) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto, sum(n1) OVER (PARTITION BY lang, source, measure) AS n
                FROM (SELECT {level}, measure, bucket, count(*) AS n1 FROM b GROUP BY 1, 2, 3, 4))
          GROUP BY lang, source, measure)
        GROUP BY lang, source"""  # noqa: E731
    sides = [f"{m}_{side}" for m in quality_rules.MEASURES for side in ("low", "high")]
    few = quality_rules.LEAST_ROWS
    picked = ", ".join(f"CASE WHEN x.n >= {few} THEN x.{m} WHEN y.n >= {few} THEN y.{m} ELSE z.{m} END AS {m}" for m in sides)
    within = " AND ".join(f"{m} BETWEEN {m}_low AND {m}_high" for m in quality_rules.MEASURES)
    return rf"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
                 list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
          FROM documents),
        g AS (SELECT r, i, list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2) || ' ' || list_extract(w, i + 3) || ' ' || list_extract(w, i + 4) AS win
              FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
        again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
        cover AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY r),
        s AS (
          SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                 CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
                 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
          FROM d LEFT JOIN cover USING (r)),
        m AS (
          SELECT *, 100 * word_chars // greatest(n_words, 1) AS letters_per_word, 100 * n_symbols // greatest(n_words, 1) AS symbols_per_word,
                 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_words,
                 n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
          FROM s),
        v AS (UNPIVOT (SELECT r, lang, source, letters_per_word, symbols_per_word, dup_lines, repeat_words FROM m) ON letters_per_word, symbols_per_word, dup_lines, repeat_words INTO NAME measure VALUE x),
        b AS (SELECT lang, source, measure, (x >> greatest(length(bin(x)) - 7, 0)) << greatest(length(bin(x)) - 7, 0) AS bucket FROM v),
        own AS ({of('lang, source')}), by_lang AS ({of('lang, NULL AS source')}), by_all AS ({of('NULL AS lang, NULL AS source')}),
        f AS (SELECT x.lang, x.source, {picked} FROM own x JOIN by_lang y ON x.lang IS NOT DISTINCT FROM y.lang, by_all z)
        SELECT doc_id, m.lang, m.source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, letters_per_word, symbols_per_word, dup_lines, repeat_words,
               base_failed, NOT base_failed AND {within} AS kept
        FROM m JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
    """


def _manifest_sql(levels: int = 8) -> str:
    """For at most 8 ** levels leaves a tree; tree -1 is that of the languages."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    text = lambda c: f"CASE WHEN text IS NULL THEN '-' ELSE CAST(octet_length(encode({c})) AS VARCHAR) || ':' || {c} END"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))

    def climb(p: str) -> str:
        """Levels p0, p1, ... of (t, i, n, d); the digests left and right of each node in p0l, p0r, ..."""
        out = []
        for k in range(levels):
            out.append(
                f"{p}{k}s AS (SELECT t, i, n, d, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {p}{k} WINDOW w AS (PARTITION BY t, i // 8 ORDER BY i))"
            )
            out.append(f"{p}{k + 1} AS (SELECT t, i // 8 AS i, any_value((n + 7) // 8) AS n, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {p}{k} GROUP BY t, i // 8)")
        return ", ".join(out)

    def path(p: str, tree: str, place: str) -> tuple[str, list[tuple[str, str]]]:
        """Joins that follow a node up, and each level's texts left and right of it (null above the root)."""
        joins = " ".join(f"LEFT JOIN {p}{k}s AS {p}j{k} ON {p}j{k}.t = {tree} AND {p}j{k}.i = {place} // {8**k} AND {p}j{k}.n > 1" for k in range(levels))
        return joins, [(f"{p}j{k}.l", f"{p}j{k}.r") for k in range(levels)]

    own, own_sides = path("a", "x.t", "x.i")
    up, up_sides = path("b", "-1", "x.t")
    sides = own_sides + up_sides
    folds = ", ".join(f"f{k + 1} AS (SELECT * EXCLUDE (d), CASE WHEN l{k} IS NULL THEN d ELSE sha256(l{k} || d || r{k}) END AS d FROM f{k})" for k in range(2 * levels))
    return f"""
        WITH crc AS (
          SELECT DISTINCT doc_id, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
                 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) AS crc
          FROM documents WHERE doc_id IS NOT NULL),
        h AS (
          SELECT d.doc_id, lang, sha256({head} || {text('text')}) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256({head} || {text(low)}) ELSE sha256({head} || {text('text')}) END AS shown
          FROM documents d LEFT JOIN crc USING (doc_id)),
        a0x AS (SELECT *, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM h),
        a0 AS (SELECT t, i, n, leaf AS d FROM a0x), {climb('a')},
        b0 AS (SELECT -1 AS t, t AS i, count(*) OVER () AS n, d FROM a{levels}), {climb('b')},
        f0 AS (
          SELECT x.doc_id, x.leaf, s.d AS subroot, (SELECT d FROM b{levels}) AS root, {', '.join(f'{a} AS l{k}, {b} AS r{k}' for k, (a, b) in enumerate(sides))}, x.shown AS d
          FROM a0x x JOIN a{levels} s ON s.t = x.t {own} {up}),
        {folds}
        SELECT doc_id, leaf, subroot, root, sha256({' || '.join(f"coalesce(l{k}, '') || coalesce(r{k}, '')" for k in range(2 * levels))}) AS proof_sha256, d AS folded_root, d = root AS verified
        FROM f{2 * levels}
    """


ORACLE_SQL = {
    "op12_hard_negatives": """
        WITH v AS (
          SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.w, b.w) AS BIGINT) AS score
          FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
        p AS (
          SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (
          SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
          FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
    "op11_merkle_manifest": _manifest_sql(),
    "op13_quality_rules": _rules_sql(),
    # The given pages carry no canonical links or refreshes, so the method's own verdict is always allow;
    # aliases are tested on small pages in tests/llm.
    "op5_url_filters": """
        WITH t AS (
          SELECT page_id,
                 translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
          FROM pages),
        r AS (
          SELECT *, CASE
              WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
          FROM t)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
        FROM r
    """,
    "op9_exact_dedup": """
        WITH t AS (
          SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
          FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
}

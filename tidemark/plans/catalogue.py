"""One query per operator over the test tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar, text
from tidemark.operators import chunking, control, dedupe, filters, records, taxonomy
from tidemark.plans.pipeline import run_pipeline
from tidemark.session import read_table
from tidemark.sources.archives import ARCHIVE_SUFFIX

QUERIES, ORACLE_SQL = {}, {}

_Q, _S = filters.QUANTITY_WORDS, filters.STRUCTURE_WORDS
_HITS = lambda col, words: " + ".join(f"(CASE WHEN contains(lower({col}), '{w}') THEN 1 ELSE 0 END)" for w in words)
#: A chunk delivered twice counts once.
_CHUNKS = "(SELECT chunk_id, any_value(source_id) AS source_id, any_value(chunk_no) AS chunk_no, any_value(text) AS text, any_value(input_type) AS input_type FROM chunks GROUP BY chunk_id)"
_RECIPES = "(SELECT DISTINCT recipe_id, title, prep_time, cook_time, base_servings, source_id FROM cayenne_recipes)"
_INGREDIENTS = "(SELECT recipe_id, ing_id, any_value(amount) AS amount, any_value(unit) AS unit, any_value(name) AS name, any_value(fallback_string) AS fallback_string FROM structured_ingredients GROUP BY recipe_id, ing_id)"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def chunks_once(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "chunks").select("chunk_id", "source_id", "chunk_no", "text", "input_type").dropDuplicates(["chunk_id"])


def extractions_once(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "recipe_extractions").drop("loaded_at").dropDuplicates(["extraction_id"])


def recipes_once(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "cayenne_recipes").drop("loaded_at").dropDuplicates(["vec_id"])


def ingredients_once(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "structured_ingredients").drop("loaded_at").dropDuplicates(["recipe_id", "ing_id"])


# --- predicates -----------------------------------------------------------------------------


@query(f"""SELECT chunk_id, CAST({_HITS('text', _Q)} AS INTEGER) AS quantity_hits, CAST({_HITS('text', _S)} AS INTEGER) AS structure_hits,
  ({_HITS('text', _Q)}) >= 2 AND ({_HITS('text', _S)}) >= 1 AS is_candidate FROM {_CHUNKS}""")
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    return chunks_once(spark, d).select(
        "chunk_id", filters.keyword_hits(F.col("text"), filters.QUANTITY_WORDS).alias("quantity_hits"),
        filters.keyword_hits(F.col("text"), filters.STRUCTURE_WORDS).alias("structure_hits"), filters.is_candidate(F.col("text")).alias("is_candidate"),
    )


@query(f"""WITH c AS (SELECT *, ({_HITS('text', _Q)}) >= 2 AND ({_HITS('text', _S)}) >= 1 AS ok FROM {_CHUNKS})
SELECT chunk_id, source_id FROM (SELECT *, bool_or(ok) OVER (PARTITION BY source_id) AS any_ok FROM c) WHERE ok OR NOT any_ok""")
def candidate_fallback(spark: SparkSession, d: str) -> DataFrame:
    return filters.keep_candidates(chunks_once(spark, d)).select("chunk_id", "source_id")


@query(f"""SELECT chunk_id, source_id FROM (SELECT *, ({_HITS('text', ['butter', 'flour', 'salt'])}) >= 2 AND contains(lower(text), 'simmer') AS ok,
  bool_or(({_HITS('text', ['butter', 'flour', 'salt'])}) >= 2 AND contains(lower(text), 'simmer')) OVER (PARTITION BY source_id) AS any_ok FROM {_CHUNKS}) WHERE ok""")
def candidate_custom_words(spark: SparkSession, d: str) -> DataFrame:
    ok = filters.is_candidate(F.col("text"), ["butter", "flour", "salt"], ["simmer"])
    return chunks_once(spark, d).where(ok).select("chunk_id", "source_id")


@query("SELECT doc_id, regexp_matches(upper(text || CASE WHEN doc_id % 3 = 0 THEN ' Baker''s percentage' ELSE '' END), 'BAKER.S (%|PERCENTAGE)') AS needs_table FROM documents")
def baker_flag(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Baker's percentage").otherwise(""))
    return read_table(spark, d, "documents").select("doc_id", filters.needs_table_normalisation(marked).alias("needs_table"))


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY chunk_no, chunk_id) AS place FROM {_CHUNKS} WHERE input_type = 'PDF'),
s AS (SELECT source_id, count(*) AS pages, avg(CASE WHEN place <= 5 THEN length(text) END) AS avg_chars FROM p GROUP BY source_id)
SELECT source_id, pages, round(avg_chars, 6) AS avg_chars, CASE WHEN pages > 2000 THEN 'too long' WHEN avg_chars < 100 THEN 'scanned' ELSE 'ok' END AS verdict FROM s""")
def preflight(spark: SparkSession, d: str) -> DataFrame:
    pages = chunks_once(spark, d).where("input_type = 'PDF'").select("source_id", F.struct("chunk_no", "chunk_id").alias("page_no"), "text")
    return filters.preflight(pages).withColumn("avg_chars", F.round("avg_chars", 6))


@query(f"""WITH n AS (SELECT doc_id, source || CASE doc_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.epub' WHEN 2 THEN '.zip' WHEN 3 THEN '.txt' WHEN 4 THEN '{ARCHIVE_SUFFIX.upper()}' ELSE '' END AS name,
  CASE WHEN doc_id % 7 = 0 THEN 'application/pdf' WHEN doc_id % 7 = 1 THEN 'application/zip' WHEN doc_id % 7 = 2 THEN 'application/epub+zip' END AS mime FROM documents)
SELECT doc_id, CASE WHEN lower(name) LIKE '%.pdf' OR mime = 'application/pdf' THEN 'pdf' WHEN lower(name) LIKE '%.epub' OR mime = 'application/epub+zip' THEN 'epub' WHEN lower(name) LIKE '%{ARCHIVE_SUFFIX}' THEN 'archive' END AS reader FROM n""")
def reader_select(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.element_at(F.array(*(F.lit(s) for s in (".PDF", ".epub", ".zip", ".txt", ARCHIVE_SUFFIX.upper(), ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    kind = F.col("doc_id") % 7
    name, mime = F.concat("source", suffix), F.when(kind == 0, "application/pdf").when(kind == 1, "application/zip").when(kind == 2, "application/epub+zip")
    return read_table(spark, d, "documents").select("doc_id", filters.select_reader(name, mime).alias("reader"))


# --- texts into chunks ----------------------------------------------------------------------

_PARAGRAPHS = f"""
p AS (SELECT chunk_id, i, unnest.v AS para FROM (SELECT chunk_id, string_split(text, E'\\n\\n') AS ps FROM {_CHUNKS} WHERE length(text) > 1000) t, unnest(ps) WITH ORDINALITY AS unnest(v, i)),
f AS (
  SELECT chunk_id, i, 0 AS part_no, length(para) + 2 AS size FROM p WHERE i = 1
  UNION ALL
  SELECT p.chunk_id, p.i, CASE WHEN f.size + length(p.para) + 2 > 1000 THEN f.part_no + 1 ELSE f.part_no END,
         CASE WHEN f.size + length(p.para) + 2 > 1000 THEN length(p.para) + 2 ELSE f.size + length(p.para) + 2 END
  FROM f JOIN p ON p.chunk_id = f.chunk_id AND p.i = f.i + 1)
"""


@query(f"""WITH RECURSIVE {_PARAGRAPHS}
SELECT f.chunk_id, CAST(f.part_no AS INTEGER) AS part_no, string_agg(p.para, E'\\n\\n' ORDER BY p.i) AS text FROM f JOIN p ON p.chunk_id = f.chunk_id AND p.i = f.i GROUP BY f.chunk_id, f.part_no
UNION ALL SELECT chunk_id, 0, text FROM {_CHUNKS} WHERE length(text) <= 1000""")
def split_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_chunks(chunks_once(spark, d).where("text is not null").select("chunk_id", "text"), "text", 1000).select("chunk_id", "part_no", "text")


@query(f"""WITH RECURSIVE b AS (SELECT source_id, string_agg(text, E'\\n\\n---\\n\\n' ORDER BY chunk_no, chunk_id) AS text FROM {_CHUNKS} WHERE input_type = 'EPUB' GROUP BY source_id),
t AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY chunk_no, chunk_id) AS i, lower(trim(regexp_replace(split_part(text, E'\\n', 1), '\\s+', ' ', 'g'))) AS title
  FROM {_CHUNKS} WHERE input_type = 'EPUB' AND trim(split_part(text, E'\\n', 1)) <> ''),
w AS (
  SELECT source_id, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS next, CAST(0 AS BIGINT) AS found_at FROM b
  UNION ALL
  SELECT w.source_id, t.i, CASE WHEN x.pos > 0 THEN w.next + x.pos ELSE w.next END, CASE WHEN x.pos > 0 THEN w.next + x.pos - 1 ELSE 0 END
  FROM w JOIN b ON b.source_id = w.source_id JOIN t ON t.source_id = w.source_id AND t.i = w.i + 1,
  LATERAL (SELECT instr(substr(lower(b.text), w.next), t.title) AS pos) x)
SELECT source_id, CAST(found_at - 1 AS INTEGER) AS start FROM w WHERE found_at > 0""")
def toc_segments(spark: SparkSession, d: str) -> DataFrame:
    """Where the first lines of a book's chapters begin in its text, one after the other."""
    books = chunks_once(spark, d).where("input_type = 'EPUB'").groupBy("source_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk_id", "text"))), lambda s: s["text"]), "\n\n---\n\n").alias("text")
    )
    heads = chunks_once(spark, d).where("input_type = 'EPUB'").select("source_id", "chunk_no", "chunk_id", F.substring_index("text", "\n", 1).alias("title")).where(F.trim("title") != "")
    titles = heads.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk_id", "title"))), lambda s: s["title"]).alias("titles"))
    found = books.join(titles, "source_id").select("source_id", F.explode(chunking.find_titles(F.col("text"), F.col("titles"))).alias("start"))
    return found


@query(f"""WITH h AS (SELECT *, lag(CASE WHEN regexp_extract(text, '\\[IMAGE: ([^\\]]+)\\]', 1) <> '' AND length(trim(regexp_replace(text, '\\[IMAGE: [^\\]]+\\]', '', 'g'), E' \\t\\r\\n')) < 120
  THEN regexp_extract(text, '\\[IMAGE: ([^\\]]+)\\]', 1) END) OVER (PARTITION BY source_id ORDER BY chunk_no, chunk_id) AS hero FROM {_CHUNKS})
SELECT chunk_id, hero IS NOT NULL AS has_hero FROM h""")
def hero_images(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunks_once(spark, d).select("chunk_id", "source_id", F.struct("chunk_no", "chunk_id").alias("chunk_no"), "text")
    return chunking.carry_hero_images(chunks).select("chunk_id", F.coalesce(F.startswith("text", F.lit("[HERO IMAGE: ")), F.lit(False)).alias("has_hero"))


# --- deduplication, merging, reconciliation -------------------------------------------------


@query("""SELECT extraction_id, source_id, name_key FROM (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY source_id, extraction_id) AS r FROM
  (SELECT DISTINCT extraction_id, source_id, regexp_replace(lower(name), '^[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+|[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+$', '', 'g') AS name_key FROM recipe_extractions WHERE name IS NOT NULL)) WHERE r = 1""")
def dedupe_exact(spark: SparkSession, d: str) -> DataFrame:
    named = extractions_once(spark, d).where("name is not null").select("extraction_id", "source_id", text.exact_key(F.col("name")).alias("name_key"))
    return dedupe.first_wins(named, F.col("name_key"), "source_id", "extraction_id")


@query("""SELECT p_partkey, k AS name_key FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p_partkey) AS r FROM
  (SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(strip_accents(p_name), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS k FROM part)) WHERE r = 1""")
def dedupe_normalised(spark: SparkSession, d: str) -> DataFrame:
    named = read_table(spark, d, "part").select("p_partkey", text.normal_name(F.col("p_name")).alias("name_key"))
    return dedupe.first_wins(named, F.col("name_key"), "p_partkey")


@query()
def dedupe_unicode(spark: SparkSession, d: str) -> DataFrame:
    """First recipe of every name in compatibility form; SQL has no such form."""
    named = extractions_once(spark, d).where("name is not null").select("extraction_id", "source_id", text.normal_name(F.col("name")).alias("name_key"))
    return dedupe.first_wins(named, F.col("name_key"), "source_id", "extraction_id")


@query("""SELECT archive_no, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY archive_no, doc_id) AS r FROM
  (SELECT CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS archive_no, doc_id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS k FROM documents WHERE title IS NOT NULL)) WHERE r = 1""")
def merge_archives(spark: SparkSession, d: str) -> DataFrame:
    """English, German, French and, last, all other documents as archives."""
    docs = read_table(spark, d, "documents").where("title is not null").select(F.col("doc_id").alias("member_no"), "title", "lang")
    archives = [docs.where(F.col("lang") == x) for x in ("en", "de", "fr")] + [docs.where("lang is null or lang not in ('en', 'de', 'fr')")]
    merged = dedupe.merge_archives(archives, text.match_key(F.col("title")))
    return merged.select("archive_no", F.col("member_no").alias("doc_id"))


@query("""WITH a AS (SELECT p_brand AS b, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS k, min(p_partkey) AS pos, arg_max(p_name, p_partkey) AS title FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
e AS (SELECT p_brand AS b, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS k, min(p_partkey) AS pos, arg_max(p_name, p_partkey) AS title FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL)
SELECT coalesce(a.b, e.b) AS source_id, CASE WHEN a.k IS NULL THEN 'extra' WHEN e.k IS NULL THEN 'missing' ELSE 'matched' END AS status, coalesce(a.title, e.title) AS title, coalesce(a.pos, e.pos) AS pos
FROM a FULL JOIN e ON a.b = e.b AND a.k = e.k""")
def recon(spark: SparkSession, d: str) -> DataFrame:
    """Even parts as expected titles of their brand, odd ones as found."""
    rows = read_table(spark, d, "part").select(F.col("p_brand").alias("source_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"))
    return dedupe.reconcile(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1"))


@query(f"""SELECT chunk_id FROM {_CHUNKS} WHERE sha256(text) NOT IN (SELECT sha256(text) FROM {_CHUNKS} WHERE chunk_no % 2 = 0 AND text IS NOT NULL) AND text IS NOT NULL""")
def checkpoint_resume(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose content is not among that of the chunks done before (the even ones)."""
    hashed = chunks_once(spark, d).where("text is not null").select("chunk_id", "chunk_no", F.sha2("text", 256).alias("h"))
    return control.resume(hashed, hashed.where("chunk_no % 2 = 0"), "h").select("chunk_id")


@query(f"""SELECT chunk_id, 'sha256:' || h AS content_hash, substr(h, 1, 16) AS file_id FROM (SELECT chunk_id, sha256(encode(text)[1:65536]) AS h FROM {_CHUNKS} WHERE text IS NOT NULL)""")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The hash of every text's first 65,536 bytes."""
    rows = chunks_once(spark, d).where("text is not null")
    return rows.select("chunk_id", scalar.content_hash(F.col("text")).alias("content_hash"), scalar.file_id(F.col("text")).alias("file_id"))


# --- names and markup -----------------------------------------------------------------------

_SMALL = "', '".join(text.SMALL_WORDS)


@query(f"""SELECT p_partkey, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND i < len(w) AND list_contains(['{_SMALL}'], lower(w[i])) AND NOT contains(w[i], '-') THEN lower(w[i])
  ELSE array_to_string(list_transform(string_split(w[i], '-'), lambda p: CASE WHEN list_contains(['{"', '".join(text.ACRONYMS)}'], upper(p)) THEN upper(p) ELSE upper(substr(p, 1, 1)) || lower(substr(p, 2)) END), '-') END), ' ') AS title
FROM (SELECT p_partkey, string_split(trim(regexp_replace(p_name || ' of the bbq pan-fried ' || p_brand, '\\s+', ' ', 'g')), ' ') AS w FROM part)""")
def title_case_names(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", text.title_case(F.concat("p_name", F.lit(" of the bbq pan-fried "), "p_brand")).alias("title"))


@query("""SELECT extraction_id, coalesce(nullif(regexp_replace(regexp_replace(name, '[^\\p{L}\\p{N} _-]', '', 'g'), '^\\s+|\\s+$', '', 'g'), ''), 'Untitled_Recipe') AS file_name
FROM (SELECT extraction_id, any_value(name) AS name FROM recipe_extractions GROUP BY extraction_id)""")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return extractions_once(spark, d).select("extraction_id", text.safe_file_name(F.col("name")).alias("file_name"))


_MARKDOWN_SQL = "'og:image: https://x.example/' || doc_id || '.jpg))' || chr(10) || '# ' || coalesce(title, '') || chr(10) || '![dish](https://x.example/i.png) [' || coalesce(title, 'x') || '](https://y.example) **' || text || '**'"


def _markdown(df: DataFrame) -> DataFrame:
    body = F.concat(
        F.lit("og:image: https://x.example/"), "doc_id", F.lit(".jpg))\n# "), F.coalesce("title", F.lit("")), F.lit("\n![dish](https://x.example/i.png) ["),
        F.coalesce("title", F.lit("x")), F.lit("](https://y.example) **"), "text", F.lit("**"),
    )
    return df.select("doc_id", body.alias("md"))


_PLAIN_SQL = _MARKDOWN_SQL
for _pattern, _to in text.MARKDOWN_MARKS:
    _PLAIN_SQL = f"regexp_replace({_PLAIN_SQL}, '{_pattern}', '{_to.replace('$', chr(92))}', 'g')"


@query(rf"""SELECT doc_id, regexp_replace({_PLAIN_SQL}, '^\s+|\s+$', '', 'g') AS plain FROM documents""")
def markdown_strip(spark: SparkSession, d: str) -> DataFrame:
    return _markdown(read_table(spark, d, "documents")).select("doc_id", text.markdown_text(F.col("md")).alias("plain"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'https://x.example/' || doc_id || '.jpg)' ELSE 'https://x.example/i.png' END AS url FROM documents""")
def image_urls(spark: SparkSession, d: str) -> DataFrame:
    md = _markdown(read_table(spark, d, "documents")).withColumn("md", F.when(F.col("doc_id") % 2 == 0, F.col("md")).otherwise(F.regexp_replace("md", "^og:image:.*\n", "")))
    return md.select("doc_id", text.image_url(F.col("md")).alias("url"))


@query(r"""SELECT doc_id, array_to_string(list_filter([trim(coalesce(title, ''), E' \t\r\n'), trim(text, E' \t\r\n'), 'Category: ' || coalesce(lang, 'none')], lambda x: x <> ''), chr(10)) AS plain
FROM (SELECT doc_id, title, lang, text FROM documents)""")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """The whole text of every document as a web page, read back."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(
        F.lit("<html><head><style>p {}</style><script>var x = 1 < 2;</script></head><body><h1> "), escaped("title"), F.lit(" </h1>\n<div>"), escaped("text"),
        F.lit("</div><p>Category: "), F.coalesce("lang", F.lit("none")), F.lit("</p></body></html>"),
    )
    return read_table(spark, d, "documents").select("doc_id", text.html_text(html).alias("plain"))


@query("""SELECT extraction_id, len(list_filter(string_split(array_to_string(list_filter(directions, lambda x: x IS NOT NULL), chr(10)), chr(10)), lambda s: trim(s, E' \\t\\r\\n') <> '')) AS n
FROM (SELECT extraction_id, any_value(directions) AS directions FROM recipe_extractions GROUP BY extraction_id) WHERE directions IS NOT NULL""")
def split_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = extractions_once(spark, d).where("directions is not null")
    return rows.select("extraction_id", F.size(text.split_lines(F.array_join("directions", "\n"))).cast("bigint").alias("n"))


# --- recipes, ingredients, tokens -----------------------------------------------------------


@query(f"""SELECT recipe_id, ing_id, '{{{{' || ing_id || '|' || fallback_string || '}}}}' AS token FROM {_INGREDIENTS} WHERE fallback_string IS NOT NULL""")
def tokens_build(spark: SparkSession, d: str) -> DataFrame:
    return ingredients_once(spark, d).where("fallback_string is not null").select("recipe_id", "ing_id", scalar.build_token(F.col("ing_id"), F.col("fallback_string")).alias("token"))


@query(f"""SELECT recipe_id, ing_id, 'Add ' || fallback_string || ' and stir.' AS shown FROM {_INGREDIENTS} WHERE fallback_string IS NOT NULL""")
def tokens_strip(spark: SparkSession, d: str) -> DataFrame:
    step = F.concat(F.lit("Add "), scalar.build_token(F.col("ing_id"), F.col("fallback_string")), F.lit(" and stir."))
    return ingredients_once(spark, d).where("fallback_string is not null").select("recipe_id", "ing_id", scalar.strip_tokens(step).alias("shown"))


def _recipe_arrays(spark: SparkSession, d: str) -> DataFrame:
    """recipe_id, ingredients in order of id, and a direction for each; every seventh recipe by hash refers to ing_99."""
    # one shuffle: rows of a recipe, repeated ones too, come together before they are compared
    rows = read_table(spark, d, "structured_ingredients").select("recipe_id", "ing_id", "amount", "unit", "name", "fallback_string").repartition("recipe_id")
    lists = rows.dropDuplicates(["recipe_id", "ing_id"]).groupBy("recipe_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("ing_id").alias("id"), F.coalesce("amount", F.lit(0.0)).alias("amount"), "unit", "name", F.coalesce("fallback_string", F.lit("")).alias("fallback_string")))).alias("ingredients")
    )
    extra = F.when(F.conv(F.substring(F.md5("recipe_id"), 1, 2), 16, 10).cast("int") % 7 == 0, F.array(F.struct(F.lit(99).alias("step"), F.lit("Serve with {{ing_99|more}}.").alias("text")))).otherwise(F.array().cast("array<struct<step:int,text:string>>"))
    steps = F.transform("ingredients", lambda s, i: F.struct((i + 1).alias("step"), F.concat(F.lit("Add "), scalar.build_token(s["id"], s["fallback_string"]), F.lit(".")).alias("text")))
    return lists.withColumn("directions", F.concat(steps, extra))


@query(f"""SELECT DISTINCT recipe_id, 'ing_99' AS dangling FROM {_INGREDIENTS} WHERE CAST('0x' || substr(md5(recipe_id), 1, 2) AS INTEGER) % 7 = 0""")
def tokens_validate(spark: SparkSession, d: str) -> DataFrame:
    bad = records.dangling_references(_recipe_arrays(spark, d))
    return bad.select("recipe_id", F.array_join("dangling", ",").alias("dangling"))


@query(f"""SELECT recipe_id, string_agg(coalesce(fallback_string, ''), chr(10) ORDER BY ing_id) AS ingredients FROM {_INGREDIENTS} GROUP BY recipe_id""")
def ingredients_text(spark: SparkSession, d: str) -> DataFrame:
    return _recipe_arrays(spark, d).select("recipe_id", F.array_join(F.transform("ingredients", lambda s: s["fallback_string"]), "\n").alias("ingredients"))


@query(f"""SELECT r.recipe_id, trim(coalesce(r.title, '') || chr(10) || string_agg(coalesce(i.fallback_string, ''), ' ' ORDER BY i.ing_id), E' \t\r\n') AS embed_text FROM (SELECT DISTINCT recipe_id, title FROM cayenne_recipes) r JOIN {_INGREDIENTS} i USING (recipe_id) GROUP BY r.recipe_id, r.title""")
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    titles = recipes_once(spark, d).select("recipe_id", "title").distinct()
    joined = titles.join(_recipe_arrays(spark, d), "recipe_id")
    return joined.select("recipe_id", scalar.embedding_input(F.col("title"), F.transform("ingredients", lambda s: s["fallback_string"])).alias("embed_text"))


@query("""WITH t AS (SELECT extraction_id, any_value(prep_time) AS p, any_value(cook_time) AS c FROM recipe_extractions GROUP BY extraction_id),
n AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(p, '(\\d+)', 1), '') AS DECIMAL(37,0)), 0) + coalesce(TRY_CAST(nullif(regexp_extract(c, '(\\d+)', 1), '') AS DECIMAL(37,0)), 0) AS total FROM t)
SELECT extraction_id, CASE WHEN coalesce(p, '') <> '' AND coalesce(c, '') <> '' AND total > 0 THEN total || ' mins' ELSE '' END AS total_time FROM n""")
def total_time(spark: SparkSession, d: str) -> DataFrame:
    return extractions_once(spark, d).select("extraction_id", scalar.total_time(F.col("prep_time"), F.col("cook_time")).alias("total_time"))


@query(f"""SELECT recipe_id, len(ing) AS ingredients, upper(substr(md5(recipe_id), 1, 8)) || '-' || upper(substr(md5(recipe_id), 9, 4)) || '-' || upper(substr(md5(recipe_id), 13, 4)) || '-' || upper(substr(md5(recipe_id), 17, 4)) || '-' || upper(substr(md5(recipe_id), 21, 12)) AS uid,
  array_to_string(list_transform(ing, lambda f: 'Add ' || f || '.'), chr(10)) || CASE WHEN CAST('0x' || substr(md5(recipe_id), 1, 2) AS INTEGER) % 7 = 0 THEN chr(10) || 'Serve with more.' ELSE '' END AS directions, coalesce(CAST(base_servings AS VARCHAR), '') AS servings
FROM (SELECT r.recipe_id, r.base_servings, list(coalesce(i.fallback_string, '') ORDER BY i.ing_id) AS ing FROM (SELECT recipe_id, min(base_servings) AS base_servings FROM cayenne_recipes GROUP BY recipe_id) r JOIN {_INGREDIENTS} i USING (recipe_id) GROUP BY ALL)""")
def assemble(spark: SparkSession, d: str) -> DataFrame:
    """Export rows of the stored recipes with their ingredients."""
    heads = read_table(spark, d, "cayenne_recipes").groupBy("recipe_id").agg(
        F.min("title").alias("title"), F.min("prep_time").alias("prep_time"), F.min("cook_time").alias("cook_time"), F.min("base_servings").alias("base_servings"),
        F.min("source_url").alias("source_url"), F.min("image_url").alias("image_url"), F.min("categories").alias("categories"),
    )
    whole = heads.join(_recipe_arrays(spark, d), "recipe_id").withColumn("n", F.size("ingredients").cast("bigint"))
    return records.export_rows(whole, "2026-01-01 00:00:00", "recipe_id", "n").select("recipe_id", F.col("n").alias("ingredients"), "uid", "directions", "servings")


_GRIDS = "(SELECT vec_id, any_value(recipe_id) AS recipe_id, any_value(grid_categories) AS grid FROM cayenne_recipes GROUP BY vec_id)"
_TAGS = f"(SELECT vec_id, recipe_id, axis, unnest(grid[axis]) AS tag FROM (SELECT vec_id, recipe_id, grid, unnest(map_keys(grid)) AS axis FROM {_GRIDS} WHERE grid IS NOT NULL))"


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return records.tags_of(recipes_once(spark, d).select(F.col("vec_id").alias("recipe_id"), "grid_categories")).withColumnRenamed("recipe_id", "vec_id")


@query(f"""SELECT vec_id, axis, tag, count(*) AS n FROM {_TAGS} WHERE length(tag) % 2 = 0 GROUP BY ALL""")
def categorize_filter(spark: SparkSession, d: str) -> DataFrame:
    """Selected tags that the taxonomy allows: here the (axis, tag) pairs with a tag of even length."""
    tags = _tags(spark, d)
    allowed = tags.where(F.length("tag") % 2 == 0).select("axis", "tag").distinct()
    return records.keep_allowed_rows(tags, allowed).groupBy("vec_id", "axis", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT vec_id, count(*) AS tags, count(DISTINCT tag) AS distinct_tags FROM {_TAGS} GROUP BY vec_id""")
def flat_categories(spark: SparkSession, d: str) -> DataFrame:
    flat = recipes_once(spark, d).select("vec_id", records.flat_tags(F.col("grid_categories")).alias("tags")).where(F.size("tags") > 0)
    return flat.select("vec_id", F.size("tags").cast("bigint").alias("tags"), F.size(F.array_distinct(F.filter("tags", lambda t: t.isNotNull()))).cast("bigint").alias("distinct_tags"))


_IDS = """(SELECT user_id, name, arg_max(id, coalesce(strftime(created_at, '%Y-%m-%d %H:%M:%S.%f'), '') || '/' || id) AS id FROM categories WHERE name IS NOT NULL GROUP BY user_id, name)"""


@query(f"SELECT user_id, name, id FROM {_IDS}")
def category_ids_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "categories").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).withColumnRenamed("user_id", "owner")
    return taxonomy.ids_by_name(rows).select(F.col("owner").alias("user_id"), "name", "id")


@query(f"""SELECT DISTINCT vec_id AS recipe_id, md5(tag) AS category_id, 'user-' || (length(tag) % 3) AS user_id FROM {_TAGS} WHERE length(tag) % 2 = 0""")
def category_junction(spark: SparkSession, d: str) -> DataFrame:
    """Junction rows of every recipe for the user who has a category of a tag's name: tags of even length here."""
    tags = _tags(spark, d).select(F.col("vec_id").alias("recipe_id"), "tag", F.concat(F.lit("user-"), (F.length("tag") % 3).cast("string")).alias("user_id"))
    ids = tags.where(F.length("tag") % 2 == 0).select("user_id", F.col("tag").alias("name"), F.md5("tag").alias("id")).distinct()
    return records.junction_rows(tags, ids)


@query("""SELECT vec_id, CASE WHEN embedding IS NOT NULL THEN 'ASSEMBLE' ELSE 'EMBED,ASSEMBLE' END AS stages, CASE WHEN embedding IS NOT NULL THEN 0 ELSE 1 END AS calls
FROM (SELECT vec_id, any_value(embedding) AS embedding FROM cayenne_recipes GROUP BY vec_id)""")
def stage_routing(spark: SparkSession, d: str) -> DataFrame:
    stages = records.route(F.lit("ARCHIVE_RECORD"), F.col("embedding"))
    return recipes_once(spark, d).select("vec_id", stages.alias("stages"), records.provider_calls(stages, F.lit(1), F.lit(False)).alias("calls"))


@query(f"""SELECT source_id, CAST(sum(1 + 2 * n + CASE WHEN t THEN 1 ELSE 0 END) AS BIGINT) AS calls FROM (SELECT c.source_id, count(e.extraction_id) AS n, bool_or(coalesce(regexp_matches(upper(c.text), 'BAKER.S (%|PERCENTAGE)'), FALSE)) AS t
  FROM {_CHUNKS} c LEFT JOIN (SELECT DISTINCT extraction_id, source_id, chunk_no FROM recipe_extractions) e USING (source_id, chunk_no) GROUP BY c.chunk_id, c.source_id) GROUP BY source_id""")
def call_cost(spark: SparkSession, d: str) -> DataFrame:
    """Provider calls per source: one extraction a chunk and two a recipe found in it."""
    found = extractions_once(spark, d).groupBy("source_id", "chunk_no").agg(F.count(F.lit(1)).alias("n"))
    chunks = chunks_once(spark, d).join(found, ["source_id", "chunk_no"], "left")
    stages = records.route(F.coalesce("input_type", F.lit("")), F.lit(None).cast("array<float>"))
    calls = records.provider_calls(stages, F.coalesce("n", F.lit(0)), F.coalesce(filters.needs_table_normalisation(F.col("text")), F.lit(False)))
    return chunks.groupBy("source_id").agg(F.sum(calls).cast("bigint").alias("calls"))


@query("""SELECT vec_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 1536 THEN 'length ' || len(embedding) END AS problem
FROM (SELECT vec_id, any_value(embedding) AS embedding FROM cayenne_recipes GROUP BY vec_id UNION ALL SELECT vec_id, embedding FROM embed_responses)""")
def embedding_check(spark: SparkSession, d: str) -> DataFrame:
    both = recipes_once(spark, d).select("vec_id", "embedding").unionByName(read_table(spark, d, "embed_responses").select("vec_id", "embedding"))
    return both.select("vec_id", records.embedding_errors(F.col("embedding")).alias("problem"))


@query(f"""WITH e AS (SELECT recipe_id, count(*) AS n FROM {_INGREDIENTS} GROUP BY recipe_id),
s AS (SELECT recipe_id, min(title) AS title, min(len(embedding)) AS dim FROM cayenne_recipes GROUP BY recipe_id)
SELECT e.recipe_id, concat_ws(',', CASE WHEN s.recipe_id IS NULL THEN 'not found' END, CASE WHEN s.recipe_id IS NOT NULL AND e.n % 3 = 0 AND s.title IS NOT NULL THEN 'title' END,
  CASE WHEN s.recipe_id IS NOT NULL AND e.n % 5 = 0 THEN 'ingredient count' END, CASE WHEN s.recipe_id IS NOT NULL AND s.dim IS NULL THEN 'embedding missing' END, CASE WHEN s.dim <> 1536 THEN 'embedding length' END) AS errors
FROM e LEFT JOIN s USING (recipe_id)""")
def verify_rows(spark: SparkSession, d: str) -> DataFrame:
    """Read-back checks; every third count expects another title, every fifth another count."""
    counts = ingredients_once(spark, d).groupBy("recipe_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    heads = read_table(spark, d, "cayenne_recipes").groupBy("recipe_id").agg(F.min("title").alias("title"), F.min_by("embedding", F.size("embedding")).alias("embedding"))
    stored = heads.join(counts, "recipe_id", "left").select("recipe_id", "title", F.coalesce("n", F.lit(0)).alias("ingredients"), "embedding")
    expected = counts.join(heads.select("recipe_id", "title"), "recipe_id", "left").select(
        "recipe_id", F.when(F.col("n") % 3 == 0, F.concat(F.lit("not "), "title")).otherwise(F.col("title")).alias("title"), F.when(F.col("n") % 5 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("ingredients")
    )
    return records.verify_rows(stored, expected).select("recipe_id", F.array_join("errors", ",").alias("errors"))


# --- taxonomies -----------------------------------------------------------------------------

_CATS = "(SELECT user_id AS owner, id, any_value(name) AS name, any_value(parent_id) AS parent_id, any_value(created_at) AS created_at FROM categories GROUP BY user_id, id)"


def _categories(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "categories").withColumnRenamed("user_id", "owner").dropDuplicates(["owner", "id"])


@query(f"""SELECT a.owner, a.name AS axis, coalesce(c.name, a.name) AS tag, count(*) AS n FROM {_CATS} a LEFT JOIN {_CATS} c ON c.owner = a.owner AND c.parent_id = a.id WHERE a.parent_id IS NULL GROUP BY ALL""")
def axes_two_level(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.axes_two_levels(_categories(spark, d)).groupBy("owner", "axis", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE c AS (SELECT * FROM {_CATS} WHERE trim(id) <> '' AND trim(name) <> ''),
t AS (SELECT owner, id, id AS root, name AS axis, 0 AS depth, name AS tag FROM c WHERE parent_id IS NULL UNION ALL SELECT c.owner, c.id, t.root, t.axis, t.depth + 1, c.name FROM c JOIN t ON c.owner = t.owner AND c.parent_id = t.id)
SELECT owner, axis, tag, count(*) AS n FROM (SELECT owner, axis, tag FROM t WHERE depth > 0 UNION ALL SELECT owner, axis, axis FROM t r WHERE depth = 0 AND NOT EXISTS (SELECT 1 FROM t k WHERE k.owner = r.owner AND k.root = r.id AND k.depth > 0)) GROUP BY ALL""")
def axes_recursive(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.axes_all_levels(_categories(spark, d)).groupBy("owner", "axis", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT db_id AS owner, trim(uid) AS id, any_value(name) AS name, any_value(trim(parent_uid)) AS parent_id, min(order_flag) AS pos FROM recipe_categories WHERE status IS DISTINCT FROM 'deleted' AND name <> '' GROUP BY ALL),
j AS (SELECT c.*, p.id AS p_id, p.name AS p_name, p.parent_id AS p_parent FROM c LEFT JOIN c p ON p.owner = c.owner AND p.id = c.parent_id),
top AS (SELECT owner, name, min(pos) AS pos FROM j WHERE parent_id IS NULL OR parent_id = '' OR p_id IS NULL GROUP BY ALL),
kid AS (SELECT DISTINCT j.owner, j.p_name AS name, j.name AS child FROM j WHERE j.p_id IS NOT NULL AND j.parent_id <> '' AND NOT EXISTS (SELECT 1 FROM c g WHERE g.owner = j.owner AND g.id = j.p_parent))
SELECT owner, name, CAST(pos AS INTEGER) AS pos, (SELECT count(*) FROM kid WHERE kid.owner = top.owner AND kid.name = top.name) AS children FROM top""")
def hierarchy_orphans(spark: SparkSession, d: str) -> DataFrame:
    rows = taxonomy.live_rows(read_table(spark, d, "recipe_categories")).groupBy(F.col("db_id").alias("owner"), F.trim("uid").alias("id")).agg(
        F.min("name").alias("name"), F.min(F.trim("parent_uid")).alias("parent_id"), F.min("order_flag").alias("pos"), F.lit(None).cast("string").alias("status")
    )
    return taxonomy.parents_with_children(rows).select("owner", "name", "pos", F.size("children").cast("bigint").alias("children"))


# --- control plane --------------------------------------------------------------------------


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def rate_window(spark: SparkSession, d: str) -> DataFrame:
    """Events of the user in the hour up to each event; one exactly an hour old does not count."""
    starts = read_table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    return control.request_window(starts, 3600, 10).select(F.col("id").alias("event_id"), "in_window")


@query("""SELECT event_id, CAST(sum(e) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM
  (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS e, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)""")
def consecutive_errors(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("is_error"))
    return control.error_runs(events).select(F.col("id").alias("event_id"), "run")


_FSM = ["start", "pause", "paused", "resume", "running", "done", "error", "cancel"]
_CASES = " ".join(f"WHEN s = '{a}' AND e = '{b}' THEN '{c}'" for (a, b), c in control.TRANSITIONS.items())


@query(f"""WITH RECURSIVE v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, (['{"','".join(_FSM)}'])[CAST(event_id % 8 AS INTEGER) + 1] AS e FROM events),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS i, 'idle' AS s, CAST(0 AS BIGINT) AS ignored FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, i, coalesce(n, s), ignored + CASE WHEN n IS NULL THEN 1 ELSE 0 END FROM (SELECT w.user_id, v.i, w.s, w.ignored, CASE {_CASES} END AS n FROM w JOIN v ON v.user_id = w.user_id AND v.i = w.i + 1))
SELECT user_id, arg_max(s, i) AS state, max(ignored) AS ignored FROM w GROUP BY user_id""")
def fsm_replay(spark: SparkSession, d: str) -> DataFrame:
    """The state of every user's job after all events, mapped onto job events by id."""
    event = F.element_at(F.array(*(F.lit(e) for e in _FSM)), (F.col("event_id") % 8 + 1).cast("int"))
    events = read_table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), event.alias("event"))
    return control.compose_replay(events, stretch=43_200).select(F.col("key").alias("user_id"), "state", "ignored")


@query("""SELECT user_id AS job_id, arg_max(event_type, ts::VARCHAR || '/' || lpad(event_id::VARCHAR, 12, '0')) AS status FROM events GROUP BY user_id""")
def job_status(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("status"))
    return control.job_status(events).select("job_id", "status")


@query("""SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'error' ELSE 'done' END AS status, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'orphaned' END AS error_message FROM orders""")
def orphan_jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "pending").otherwise("done")
    return control.fail_orphans(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"))).select("job_id", "status", "error_message")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'Metric' WHEN 'view' THEN 'Imperial' ELSE 'US' END AS system, CASE event_type WHEN 'click' THEN 'metric' WHEN 'view' THEN 'imperial' ELSE 'us' END AS units,
  coalesce(regexp_matches(lower(CASE WHEN event_id % 4 = 0 THEN 'HTTP 429' WHEN event_id % 4 = 1 THEN 'RESOURCE_EXHAUSTED' ELSE event_type END), '429|quota|resource_exhausted'), FALSE) AS limited FROM events""")
def unit_systems(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("event_type") == "click", "metric").when(F.col("event_type") == "view", "imperial").otherwise("book")
    system = scalar.unit_system(flag)
    message = F.when(F.col("event_id") % 4 == 0, "HTTP 429").when(F.col("event_id") % 4 == 1, "RESOURCE_EXHAUSTED").otherwise(F.col("event_type"))
    return read_table(spark, d, "events").select("event_id", system.alias("system"), scalar.units_key(system).alias("units"), scalar.is_rate_limit_error(message).alias("limited"))


@query("SELECT CAST(k AS INTEGER) AS attempt, CAST(least(2 * power(2, k - 1), 120) AS INTEGER) AS seconds FROM range(1, 9) r(k)")
def backoff(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(scalar.backoff_delays(8)).alias("attempt", "seconds")).select((F.col("attempt") + 1).alias("attempt"), "seconds")


# --- the record pipeline --------------------------------------------------------------------


@query()
def pipeline_records(spark: SparkSession, d: str) -> DataFrame:
    """Final records of all documents by the offline provider."""
    docs = read_table(spark, d, "documents").select(F.col("source_id"), F.col("doc_id").alias("chunk_no"), "text", F.lit("URL").alias("input_type"))
    axes = {"Meal": ["Soup", "Salad", "Cake", "Curry"], "Main": ["Chicken", "Tofu", "Beef", "Lentil"]}
    made, _ = run_pipeline(docs, axes)
    return made.select("source_id", "chunk_no", "recipe_no", "title", F.size("ingredients").alias("ingredients"), F.size("directions").alias("directions"), F.array_join("categories", ",").alias("categories"))


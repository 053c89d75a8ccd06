"""Template residue, filler, error pages and script notices instead of content.

A text is excluded when it holds an unfilled placeholder anywhere, or when nothing but evidence is
left of it: its lines and sentences are labelled by patterns as error, script notice, filler or page
furniture; lines that recur, by host, on pages with such evidence or on most pages of the host are
counted and subtracted as boilerplate; filler vocabulary is learnt from the pages that announce filler. What remains is content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

_NAME = r"[A-Za-z][\w .\-]*"
_TAGS = "a|b|i|u|p|s|br|hr|em|li|ol|ul|td|th|tr|tt|dd|dl|dt|h[1-6]|img|div|pre|sub|sup|body|code|font|form|head|html|link|meta|span|table|tbody|thead|strong|script|style|title|center|small|input|label|blockquote"

#: Unfilled placeholders of common template languages, by the form they take.
PLACEHOLDERS = [
    r"\{\{\{?\s*[^{}|\n]+\s*\}?\}\}",  # {{name}}, {{ a.b }}, {{{name}}}
    r"\{\{\s*[^{}|\n]+\|\s*\}\}",  # a token of the project without its text
    r"(?<![{$#%\w])\{[A-Za-z]\w*\}(?!\})",  # {name}
    r"[$#]\{\s*[A-Za-z][\w.]*\s*\}",  # ${name}, #{name}
    r"<%[=-]?[^%\n]*%>",
    r"\{%[^%\n]*%\}",
    r"%\([A-Za-z_]\w*\)[sdif]",
    r"(?<![\w%])%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*%(?!\w)",
    r"@@[A-Za-z]\w*@@",
    r"(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)",
    r"<<\s*[A-Za-z][\w ]*>>",
    r"\[\[\s*[A-Za-z]\w*\s*\]\]",
    r"(?i)\[(?:your|insert|enter|add)\s[^\]\n]+\]",
    r"(?i)\[[^\]\n]+\s(?:goes )?here\]",
    rf"&lt;(?!/?(?:{_TAGS})\b){_NAME}&gt;",
    rf"<(?!/?(?:{_TAGS})\b)[a-z]+(?:_[a-z]+)+>",
]

#: What an error page says, whole segments from their beginning.
ERRORS = [
    r"(?:http )?(?:error|erreur|fehler)\s*:?\s*[45]\d\d\b",
    r"[45]\d\d\s*[:\-–]?\s*(?:not found|gone|forbidden|unauthorized|bad gateway|bad request|too many requests|internal server error|service (?:temporarily )?unavailable|gateway time-?out|request time-?out|method not allowed)",
    r"(?:page|file|object) not found", r"not found$", r"access denied", r"forbidden$",
    r"(?:fatal|parse|internal server|database|unexpected) error", r"uncaught (?:exception|error)", r"traceback \(most recent call",
    r"you don.t have permission to (?:view|access)", r"your session has (?:expired|timed out)", r"sign in again",
    r"oops[!.,]", r"we can.t find (?:that|this|the) ", r"(?:sorry, )?(?:the |this )?(?:page|recipe)[^.]* (?:could not be|cannot be|can.t be|was not) found",
    r"the page you (?:asked for|requested|are looking for)", r"something went wrong",
    r"página no encontrada", r"la (?:receta|página) que buscas ya no", r"no se (?:ha )?encontr",
    r"seite nicht gefunden", r"das gesuchte .* nicht mehr verfügbar", r"die (?:angeforderte )?seite .* nicht",
    r"(?:la )?page (?:demandée )?(?:est )?(?:introuvable|non trouvée)", r"service (?:temporarily )?unavailable", r"bad gateway",
]
#: What a page says that needs scripts.
SCRIPTS = [
    r"(?:please )?(?:enable|activate|turn on|allow) (?:javascript|scripts|cookies)", r"javascript is (?:disabled|required|turned off|not enabled)",
    r"(?:this|the) (?:site|page|app|application) (?:requires|needs) (?:javascript|scripts)", r"you need to (?:enable|allow|activate|turn on) (?:javascript|scripts)",
    r"turn it on in your browser", r"checking your browser", r"scripts and cookies must", r"we.re sorry, but this app doesn.t work",
    r"verify you are human", r"active javascript", r"(?:habilite|activa) javascript", r"veuillez activer javascript", r"bitte aktivieren sie javascript",
]
#: Filler that stands where content will come.
FILLERS = [
    r"lorem ipsum", r"(?:recipe |content )?coming soon", r"check back (?:later|soon)", r"under construction", r"this (?:recipe|page) has no content", r"próximamente", r"contenu à venir", r"hier entsteht", r"inhalt folgt",
    r"todo\b.*", r"tb[dac]$", r"to be (?:written|added|done|determined)", r"(?:step|ingredient|item|heading|title|paragraph) \d+(?:\s*:\s*(?:describe|add|insert|write) .*)?$",
    r"(?:heading|title|text|your [\w ]+|caption|image) goes here", r"this is (?:sample|dummy|placeholder|example) (?:text|content)", r"replace this (?:paragraph|text|sentence)",
    r"add (?:a|your|the) (?:short )?(?:description|text|introduction)[^.]* here", r"(?:sub-?title|title|heading|image|text) placeholder", r"sample (?:heading|title|text|paragraph)", r"placeholder\b",
    r"(?:(?:asdf\w*|qwer\w*|zxcv\w*|hjkl|blah|bla|xxx+|test|testing|foo|bar|baz|dummy)[\s,.;]*)+$",
]
#: Furniture of any page: it is neither evidence nor content.
FURNITURE = [
    r"home\s*[|>»–-]", r".*[–|»]\s*(?:menu|search|log ?in)\b", r"skip to (?:main )?content", r"(?:menu|search|home|contact|privacy|about|imprint|log ?in|sign (?:in|up)|loading)\W*$",
    r"loading(?:…|\.)*$", r"(?:please )?try again (?:later|in a few)", r"please try again", r"try the search box", r"(?:or )?return to the (?:start|home) ?page", r"if this keeps happening", r"contact the site owner",
    r"back to (?:the )?(?:kitchen|home|top|start)", r"browse all", r"(?:request|reference|trace|incident) id\b", r"retour à l.accueil", r"zurück zur", r"volver a", r"privacy(?: policy)?$", r"cookie", r"©|copyright\b",
]


def _any(patterns: list[str]) -> str:
    return "(?iu)^\\W*(?:" + "|".join(patterns) + ")"


_EVIDENCE = _any(ERRORS + SCRIPTS + FILLERS)
#: The same at the beginning of any line or sentence of a whole text.
_EVIDENCE_ANYWHERE = "(?ium)(?:^|(?<=[.!?…])\\s)\\W*(?:" + "|".join(ERRORS + SCRIPTS + FILLERS) + ")"
#: One sentence or line three times or more and nothing else.
_REPEATED = r"^\s*(\S[^\n]{2,}?(?:[.!?…]|(?=\n)))\s+\1\s+\1(?:\s+\1)*\s*$"
_SEED = "(?ium)^\\W*(?:lorem ipsum|(?:recipe |content )?coming soon|próximamente|contenu à venir|hier entsteht|this (?:recipe|page) has no content)"
_PLACEHOLDER = "|".join(f"(?:{p})" for p in PLACEHOLDERS)


#: Every placeholder has one of these; texts without are not looked at any closer.
_MARKS = r"[{<@$]|\[|%|__|&lt;"


def has_placeholder(text: Column) -> Column:
    """Whether the text holds an unfilled placeholder; filled tokens and image markers are none."""
    return text.rlike(_MARKS) & text.rlike(_PLACEHOLDER)


def _segments(text: Column) -> Column:
    """Lines, and the sentences of lines of more than 70 characters; blank ones are left out."""
    parts = F.flatten(
        F.transform(F.split(text, r"\R+"), lambda s: F.when(F.length(s) > 70, F.split(s, r"(?<=[.!?…])\s+")).otherwise(F.array(s)))
    )
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def _key(segment: Column) -> Column:
    """Normal form for counting: lower case, numbers and identifiers as 0, one blank between words."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(segment), r"\b(?=\w*\d)[0-9a-f]{6,}\b|\d+", "0"), r"(?U)\s+", " "
    )


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def _lender(df: DataFrame, limit: int):
    """Marks ``df`` for broadcast if it has at most ``limit`` rows; leaves it as it is beyond that."""
    return F.broadcast if df.count() <= limit else (lambda other: other)


def exclude_residue(
    documents: DataFrame, id_col: str, text_col: str, url_col: str, min_words: int = 4,
    min_lines: int = 3, boilerplate_share: float = 0.5, lexicon_share: float = 0.02,
    broadcast_limit: int = 1_000_000, host_share: float = 0.5,
) -> DataFrame:
    """(id, reason) of the documents to exclude; reason is 'placeholder' or 'no content'.

    Content is any segment of at least ``min_words`` words that is not evidence, furniture,
    boilerplate (a line seen on ``min_lines`` pages of its host or more, ``boilerplate_share`` of them
    with evidence; or, whatever their evidence, on ``min_lines`` different texts and ``host_share`` of the
    host's pages, which copies of one text or pages without a host do not make) or filler (six in ten words from the filler vocabulary: words of which
    ``lexicon_share`` of the pages, and two at least, announce filler). A text of one sentence
    repeated three times or more is filler too. Evidence that stands on most pages of its host is
    boilerplate, no evidence. Null and blank texts have no evidence and stay; an id
    comes out once, whatever rows repeat it. Counts run over all documents, read once; only pages with
    evidence are read again. The ids of those pages and the filler words are broadcast while there are at most ``broadcast_limit`` of them, and joined beyond that.
    """
    docs = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
        F.coalesce(F.lower(F.regexp_extract(url_col, r"^\w+://([^/:?#]+)", 1)), F.lit("")).alias("host"),
    )
    # one pass over the texts: flags, and lines and words as 64-bit hashes; later steps read this narrow table.
    # no filter here: it would be pushed down and run the patterns a second time
    segments = _segments(F.col("text"))
    repeated = F.col("text").rlike(_REPEATED)
    parsed = cut(docs.select(
        "id", "host", has_placeholder(F.col("text")).alias("placeholder"), (F.col("text").rlike(_EVIDENCE_ANYWHERE) | repeated).alias("evidence"), F.col("text").rlike(_SEED).alias("seed"),
        F.expr("shiftleft(1L, cast(pmod(xxhash64(text), 64) as int))").alias("bit"),
        F.array_distinct(F.transform(segments, lambda s: F.xxhash64(_key(s)))).alias("keys"), F.array_distinct(F.transform(_words(F.col("text")), lambda w: F.xxhash64(w))).alias("words"),
    ))
    placeholder = parsed.where("placeholder").select("id").distinct().withColumn("reason", F.lit("placeholder"))

    # lines by host over all documents; a bit for each of 64 kinds of texts: as many bits as min_lines need as many different texts at least
    lines = parsed.select("host", "evidence", "bit", F.explode("keys").alias("key"))
    pages = parsed.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    recurrent = lines.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("evidence").alias("bad"), F.bit_count(F.bit_or("bit")).alias("texts")).where(F.col("n") >= min_lines)
    on_host = F.coalesce((F.col("texts") >= min_lines) & (F.col("n") >= host_share * F.col("pages")), F.lit(False))
    boilerplate = recurrent.join(pages, "host", "left").where((F.col("bad") >= boilerplate_share * F.col("n")) | on_host).select("host", "key", F.lit(True).alias("boilerplate"), on_host.alias("on_host"))
    seeded = parsed.select("id", "seed", F.explode("words").alias("word"))
    lexicon = cut(
        seeded.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("seed").alias("seeds"))
        .where((F.col("seeds") >= 2) & (F.col("seeds") >= lexicon_share * F.col("n"))).select("word", F.lit(True).alias("filler"))
    )
    fillers = seeded.join(_lender(lexicon, broadcast_limit)(lexicon), "word").groupBy("id").agg(F.count(F.lit(1)).alias("hits")).where("hits >= 5")

    # whole texts are read again for suspects only: the pages with evidence, and those with filler words
    wanted = cut(parsed.where("evidence").select("id").unionByName(fillers.select("id")).distinct().join(placeholder, "id", "left_anti"))
    found = docs.join(_lender(wanted, broadcast_limit)(wanted), "id", "left_semi").dropDuplicates(["id"])
    suspects = found.select("id", "host", segments.alias("segments"), repeated.alias("repeated"))
    parts = suspects.select("id", "host", "repeated", F.posexplode("segments").alias("pos", "segment")).select(
        "id", "host", "repeated", "pos", F.xxhash64(_key(F.col("segment"))).alias("key"), F.col("segment").rlike(_EVIDENCE).alias("evidence"),
        F.col("segment").rlike(_any(FURNITURE)).alias("furniture"), F.transform(_words(F.col("segment")), lambda w: F.xxhash64(w)).alias("words"),
    )
    labelled = parts.join(boilerplate, ["host", "key"], "left")
    counted = (
        labelled.select("*", F.explode_outer("words").alias("word")).join(lexicon, "word", "left")
        .groupBy("id", "pos").agg(
            (F.first("evidence") & ~F.coalesce(F.first("on_host"), F.lit(False))).alias("evidence"), F.first("furniture").alias("furniture"), F.first("repeated").alias("repeated"),
            F.coalesce(F.first("boilerplate"), F.lit(False)).alias("boilerplate"), F.count("word").alias("n"), F.count("filler").alias("fill"),
        )
    )
    # what is left once the boilerplate is subtracted decides: evidence that stands on most pages of its host is none
    filler = (F.col("n") > 0) & (F.col("fill") >= 0.6 * F.col("n"))
    content = ~(F.col("evidence") | F.col("furniture") | F.col("boilerplate") | F.col("repeated") | filler) & (F.col("n") >= min_words)
    empty = counted.groupBy("id").agg(
        F.count_if(content).alias("content"), F.count_if(F.col("evidence") | F.col("repeated") | filler).alias("evidence")
    ).where("content = 0 and evidence > 0")
    both = placeholder.unionByName(empty.select("id", F.lit("no content").alias("reason")))
    return both.groupBy("id").agg(F.max("reason").alias("reason"))

"""Catalogue hygiene: flags by title and shelf, omnibus volumes, duplicate clusters, weights and years.

Defined results: a null title is an empty one; missing shelf counts are 0; works without a page count are of
unknown length; tied works go by their smallest id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectorium.functions.text import core_title, normalize_title

#: Title patterns, shelves, weights and bounds of works that aren't one plain book.
COLLECTION = (
    r"(?i)"
    r"\bcomplete\s+works\b"
    r"|\bcollected\s+(stories|fictions|fiction|poems|poetry|plays|works|essays|short\s+stories)\b"
    r"|\bomnibus\b"
    r"|\banthology\b"
    r"|\banthologies\b"
    r"|\briverside\s+shakespeare\b"
    r"|\bcomplete\s+calvin\b"
    r"|\bboxed\s+set\b"
    r"|\bbox\s+set\b"
    r"|\bboxset\b"
    r"|\bcomplete\s+collection\b"
    r"|\bshort\s+stories\s+of\b"
    r"|\bthe\s+complete\s+[a-z]"
    r"|\bvolumes?\s+\d+\s*[-–—]\s*\d+"
    r"|\b(?:vol\.?|volume)\s*\d+\s*[-–—]\s*(?:vol\.?|volume)?\s*\d+"
    r"|[#]\s*\d+(?:\.\d+)?\s*[-–—]\s*\d+(?:\.\d+)?"
    r"|\bcollection\s*\([^)]*[#]\s*\d"
    r"|\b(?:complete|entire)\s+series\b"
    r"|\b(?:trilogy|quartet|pentalogy|tetralogy|hexalogy)\s+(?:omnibus|boxed|box\s*set|collection|set)\b"
    r"|\b(?:omnibus|boxed|box\s*set|collection)\b.{0,40}\b(?:trilogy|quartet|pentalogy)\b"
    r"|\b(?:books?|novels?)\s+\d+\s*[-–—]\s*\d+"
    r"|\ba\s+[\w'&.\s]{0,50}\bcollection\b"
    r"|\band\s+other\s+(stories|tales|writings|poems|essays)\b"
    r"|\bother\s+(stories|tales|writings)\b"
    r"|\bshort\s+fiction\b"
    r"|\b(?:un)?collected\s+stories\b"
    r"|\bbest of\b.{0,80}\b(?:stories|fiction|tales|fictions)\b"
    r"|\b(?:two|three|four|five)\s+novels?\b"
    r"|\b(?:two|three|four)\s+novellas?\b"
)
SINGLE_VOLUME = r"(?i)[,:(]\s*[#]\s*\d+(?:\.\d+)?\s*\)?\s*$|[#]\s*\d+(?:\.\d+)?\s*\)\s*$|\bpart\s+(?:one|two|three|\d+)\b"
VOLUME_RANGE = r"[#]\s*\d+(?:\.\d+)?\s*[-–—]\s*\d+(?:\.\d+)?"
COLLECTION_CUE = r"(?i)\bshort\s+stories\b|\bshort\s+fiction\b|\bstories\b|\bfictions\b|\btales\b|\bfables\b|\bpoems\b|\bessays\b|\bwritings\b|\bnovellas\b|\bchronicles\b"
DERIVATIVE = (
    r"(?i)"
    r"\bscreenplay\b"
    r"|\bfilm\s+diary\b"
    r"|\bmonarch\s+notes\b"
    r"|\bcliff'?s?\s+notes\b"
    r"|\bsparknotes\b"
    r"|\bstudy\s+guide\b"
    r"|\bcompanion\s+to\b"
    r"|\b(?:movie|film)\s+companion\b"
    r"|\billustrated\s+(?:movie\s+)?companion\b"
    r"|\bannotated\s+bibliography\b"
    r"|\b10th\s+anniversary\s+exhibit\b"
    r"|\banniversary\s+exhibit\b"
    r"|\bthe\s+art\s+of\b.{0,60}\b(?:movie|film|cinema|animation|pixar|disney|fellowship|two\s+towers|return\s+of\s+the\s+king|star\s+wars|harry\s+potter|game\s+of\s+thrones|incredibles)\b"
    r"|\bart\s+of\s+the\s+(?:fellowship|two\s+towers|return|hobbit|incredibles)\b"
    r"|\b(?:the\s+)?making\s+of\s+the\s+(?:movie|film|picture)\b"
    r"|\b(?:the\s+)?making\s+of\b.{0,40}\b(?:movie|film)\s+trilogy\b"
    r"|\bbehind\s+the\s+scenes\s+of\b"
    r"|\breader'?s?\s+companion\b"
    r"|\billustrated\s+history\b"
    r"|\bfor\s+soprano\b"
    r"|\bfor\s+piano\b"
    r"|\band\s+orchestra\b"
    r"|\bsheet\s+music\b"
    r"|\bpiano\s+vocal\b"
    r"|\bvocal\s+score\b"
)
#: Words by which one volume of a series is a derivative all the same.
SURE_DERIVATIVE = r"(?i)\b(?:screenplay|study\s+guide|monarch\s+notes|cliff'?s?\s+notes|sparknotes|movie\s+companion|film\s+companion|illustrated\s+companion|for\s+soprano|for\s+piano|sheet\s+music|vocal\s+score)\b"
COMIC = r"(?i)\bgraphic\s+novels?\b|\bmanga\b|\bmanhwa\b|\bwebtoon\b|\bbande\s+dessin"
SHELVES = {
    "fiction": ("fiction", "novels", "novel", "literary-fiction", "literature", "classic-fiction", "adult-fiction", "general-fiction", "contemporary-fiction"),
    "nonfiction": ("non-fiction", "nonfiction", "non_fiction", "reference", "biography", "memoir", "history", "science", "self-help", "selfhelp", "art", "photography", "essay", "essays", "criticism", "literary-criticism"),
    "short": ("short-stories", "short-story"),
    "bundle": ("anthologies", "anthology", "collections", "collection", "omnibus", "box-set", "boxed-set"),
    "comic": (
        "graphic-novels", "graphic-novel", "graphicnovels", "graphicnovel", "comics", "comic", "comic-books", "comic-book", "comics-graphic-novels", "graphic-novels-comics",
        "comics-and-graphic-novels", "graphic-novels-and-comics", "comic-graphic-novel", "graphic-novel-comic", "manga", "mangas", "comics-manga", "manga-comics", "comics-and-manga",
        "manga-and-comics", "manga-manhwa", "manhwa", "webtoon", "webtoons", "bd", "bande-dessinee", "dc-comics", "marvel-comics", "graphic-novels-manga", "manga-graphic-novels", "read-manga", "read-comics",
    ),
    "picture": ("picture-books", "picture-book", "board-books", "board-book", "childrens-picture-books"),
}
STANDALONE_PAGES = 140
WEIGHTS = {"is_collection": 0.18, "is_derivative": 0.12, "is_comic": 0.18}
BOTH = 0.08


def _has(title: Column, pattern: str) -> Column:
    return title.rlike("(?U)" + pattern)


def title_flags(works: DataFrame) -> DataFrame:
    """is_collection, is_derivative and is_comic by the title's words. One volume of a series is a derivative
    only by words that leave no doubt."""
    t = F.coalesce("title", F.lit(""))
    derivative = _has(t, DERIVATIVE) & (~_has(t, SINGLE_VOLUME) | _has(t, SURE_DERIVATIVE))
    return works.withColumns({"is_collection": _has(t, COLLECTION), "is_derivative": derivative, "is_comic": _has(t, COMIC)})


def shelf_counts(shelves: DataFrame, groups: dict[str, tuple] = SHELVES) -> DataFrame:
    """Sums of counts per work and group of shelves in one pass: work_id, fiction_n, nonfiction_n, ..., and
    collection_n, that of short and bundle together."""
    groups = groups | {"collection": groups["short"] + groups["bundle"]}
    s = F.lower("shelf")
    every = tuple(dict.fromkeys(x for g in groups.values() for x in g))
    return shelves.filter(s.isin(*every)).groupBy("work_id").agg(*[F.sum(F.when(s.isin(*g), F.col("count")).otherwise(0)).cast("long").alias(f"{name}_n") for name, g in groups.items()])


def shelf_flags(works: DataFrame, counts: DataFrame, pages: DataFrame) -> DataFrame:
    """title_flags(works) joined with what shelves(work_id, *_n) and pages(work_id, num_pages) tell: shelves of
    many works, of comics, of non-fiction and of picture books, each against those of fiction."""
    w = title_flags(works).join(counts, "work_id", "left").join(pages.select("work_id", "num_pages"), "work_id", "left")
    n = lambda c: F.coalesce(F.col(f"{c}_n"), F.lit(0))
    t, fiction = F.coalesce("title", F.lit("")), F.greatest(n("fiction"), F.lit(1))
    one = _has(t, SINGLE_VOLUME) & ~_has(t, VOLUME_RANGE)
    bundled = (n("bundle") >= 30) & (n("bundle") >= fiction * 0.12)
    cued = _has(t, COLLECTION_CUE) | _has(t, COLLECTION)
    short = (n("bundle") < 30) & (F.col("num_pages").isNull() | (F.col("num_pages") < STANDALONE_PAGES))
    shelved = (n("collection") >= 40) & (n("collection") >= fiction * 0.5) & ~one & (bundled | cued | (~short & (n("collection") >= 120) & (n("collection") >= fiction * 0.9)))
    over = lambda c: (n(c) >= 10) & (n(c) > n("fiction") * 1.15)
    flags = {
        "is_collection": F.col("is_collection") | shelved, "is_comic": F.col("is_comic") | over("comic"), "is_nonfiction": over("nonfiction"),
        "is_picture_book": (n("picture") >= 40) & ((n("picture") >= fiction * 0.25) | F.coalesce(F.col("num_pages") <= 64, F.lit(False))),
    }
    return w.withColumns(flags)


def override(flags: DataFrame, forced: DataFrame, never: DataFrame, deweight: DataFrame | None = None) -> DataFrame:
    """Flags after curated lists: never(work_id, flag) are cleared, forced(work_id, flag) are set; a work's
    own weight is the least that its flags and deweight(work_id, weight) allow."""
    names = list(WEIGHTS)
    wide = lambda d, p: d.groupBy("work_id").agg(*[F.bool_or(F.col("flag") == n).alias(p + n) for n in names])
    j = flags.join(wide(forced, "f_"), "work_id", "left").join(wide(never, "n_"), "work_id", "left")
    j = j.withColumns({n: (F.col(n) & ~F.coalesce(F.col("n_" + n), F.lit(False))) | F.coalesce(F.col("f_" + n), F.lit(False)) for n in names}).withColumn("format_weight", format_weight())
    if deweight is not None:
        given = deweight.groupBy("work_id").agg(F.min("weight").alias("given"))
        j = j.join(given, "work_id", "left").withColumn("format_weight", F.least("format_weight", F.coalesce("given", F.lit(1.0)))).drop("given")
    return j.drop(*[p + n for p in ("f_", "n_") for n in names])


def format_weight() -> Column:
    parts = [F.when(F.col(n), w).otherwise(1.0) for n, w in WEIGHTS.items()]
    return F.least(F.lit(1.0), *parts, F.when(F.col("is_collection") & F.col("is_derivative"), BOTH).otherwise(1.0))


def slash_parts(title: Column) -> Column:
    """The parts of a title such as `A / B` outside brackets; null for dates, sheet music and single titles."""
    raw = F.coalesce(title, F.lit(""))
    outside = F.trim(F.regexp_replace(F.regexp_replace(raw, "\\([^)]*\\)", " "), "\\s+", " "))
    cut = F.when(outside.contains(" / "), F.split(outside, "\\s*/\\s*")).when(outside.rlike("[A-Za-z]/[A-Za-z]"), F.split(outside, "/"))
    parts = F.filter(F.transform(cut, lambda p: F.trim(p)), lambda p: (F.length(p) >= 3) & ~p.rlike("^\\d+([./]\\d+)*$"))
    no = raw.rlike("\\d{1,2}/\\d{1,2}/\\d{2,4}") | raw.rlike("(?i)\\bpiano\\s*/\\s*vocal|\\bvocal\\s*/\\s*guitar")
    return F.when(~no & (F.size(parts) >= 2), parts)


def slash_omnibus(works: DataFrame, stats: DataFrame, least_parts: int = 2, least_prefix: int = 12) -> DataFrame:
    """Titles such as `A / B` of which at least least_parts parts are different other works of the author:
    work_id, parts, first_year. A part, or what follows its colon, is a work's title without brackets or, from
    least_prefix characters on, its beginning; exact matches go before others, then the most rated. Titles in
    other scripts are left alone. Beginnings are listed by word, so that all matches are equalities. A title
    with parts is nobody's sibling, so no row meets itself, and ids of omnibus and sibling may be equal."""
    w = works.join(stats.select("work_id", "n"), "work_id", "left").withColumn("_parts", slash_parts(F.col("title")))
    foreign = lambda p: F.length(F.regexp_replace(p, "[^\\p{L}]|[\\x00-\\x7F]", "")) > 0.4 * F.length(F.regexp_replace(p, "[^\\p{L}]", ""))
    cut = w.filter(F.col("_parts").isNotNull() & ~F.exists("_parts", foreign)).select("work_id", "author_id", F.posexplode("_parts").alias("at", "part"))
    after = F.trim(F.regexp_extract("part", "^[^:]*:(.*)$", 1))
    keys = F.array_distinct(F.array(normalize_title(F.col("part")), F.when(F.length(after) >= 3, normalize_title(after)).otherwise("")))
    cut = cut.select("work_id", "author_id", "at", F.posexplode(F.filter(keys, lambda k: k != "")).alias("turn", "key"))
    norm = core_title(F.col("title"))
    own = w.filter("_parts IS NULL").select(F.col("work_id").alias("sibling"), "author_id", F.coalesce("n", F.lit(0)).alias("n"), "pub_year", norm.alias("norm")).filter("norm <> ''")
    words = F.split("norm", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " "))
    own = own.withColumn("key", F.explode(F.filter(starts, lambda k: (k == F.col("norm")) | (F.length(k) >= least_prefix))))
    hit = cut.join(own, ["author_id", "key"])
    best = hit.groupBy("work_id", "at").agg(F.max_by(F.struct("sibling", "pub_year"), F.struct(F.col("key") == F.col("norm"), "n", -F.col("sibling"))).alias("b"))
    return best.groupBy("work_id").agg(F.count_distinct("b.sibling").alias("parts"), F.min("b.pub_year").alias("first_year")).filter(F.col("parts") >= least_parts)


def duplicate_clusters(works: DataFrame, stats: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """Works of one author, normalised title and language: work_id, canonical_id (most ratings, then smallest
    id), cluster size. Clusters that mix collections with single works stay apart. Without a language column
    all are of one language. Clusters are summed, not windowed, and joined back."""
    lang = F.substring(F.lower(F.coalesce("language_code", F.lit(""))), 1, 2) if "language_code" in works.columns else F.lit("")
    w = works.join(stats.select("work_id", "n"), "work_id").select("work_id", "author_id", "is_collection", "n", normalize_title(F.coalesce("title", F.lit(""))).alias("norm"), lang.alias("lang"))
    keys = ["author_id", "norm", "lang"]
    c = w.filter("norm <> ''").groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.max_by("work_id", F.struct("n", -F.col("work_id"))).alias("best"), F.min("is_collection").alias("low"), F.max("is_collection").alias("high"))
    c = w.join(c.filter((F.col("size") > 1) & (F.col("low") == F.col("high"))), keys, "left").withColumn("canonical_id", F.coalesce("best", "work_id"))
    if canonical is not None:
        c = c.join(canonical.select("work_id", F.col("canonical_id").alias("given")), "work_id", "left").withColumn("canonical_id", F.coalesce("given", "canonical_id"))
    return c.select("work_id", "canonical_id", F.coalesce("size", F.lit(1)).cast("long").alias("size"))


def work_years(editions: DataFrame, overrides: DataFrame, inherited: DataFrame | None = None, low: int = 1500, high: int = 2030) -> DataFrame:
    """First year of a work within the band; overrides win over all, inherited years over editions."""
    y = editions.filter(F.col("pub_year").between(low, high)).groupBy("work_id").agg(F.min("pub_year").alias("first"))
    y = y.join(overrides.select("work_id", F.col("pub_year").alias("given")), "work_id", "full")
    picks = ["given", "first"]
    if inherited is not None:
        y = y.join(inherited.select("work_id", F.col("first_year").alias("parent")), "work_id", "left")
        picks = ["given", "parent", "first"]
    return y.select("work_id", F.coalesce(*picks).cast("int").alias("pub_year"))


def in_years(works: DataFrame, years: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Works whose year in years(work_id, pub_year) is known and within the bounds; None is no bound."""
    keep = years.filter(F.col("pub_year").isNotNull() & (F.col("pub_year") >= low if low is not None else F.lit(True)) & (F.col("pub_year") <= high if high is not None else F.lit(True)))
    return works.join(keep.select("work_id"), "work_id", "left_semi")

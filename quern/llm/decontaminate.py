r"""Benchmark decontamination by template canonicalisation, in Spark expressions alone.

A text is split into words: runs of digits with inner points or commas, and runs of other
letters, marks, numerals and hyphens.  There are two readings of the words.  The verbatim one is the
words in lower case.  In the template, names (capitalised words of two letters or more, wherever
they stand, be it the start of a sentence), numbers (in digits or of ``NUMBER_WORDS``) and units
(words of ``UNITS`` after a number) are placeholders, so that a question keeps its template when its values are exchanged.

Windows of ``WINDOW`` consecutive words of items and documents meet in an equi-join on
their hashes, each reading with itself, each with its position, which gives alignments of
an item in a document: pairs of positions with one offset.  A place is one offset, or a range of
offsets that allows for inserted words.  An item counts as found at a place where at least
``COVERAGE`` of its windows or ``RUN`` consecutive words of it match, and where, in the
template, its slots are consistent: word by word within the matched windows, every value
of the item becomes one value of the document and the other way round.

Placeholders alone say nothing: a template window counts only if half of its words are
literal, and a place, in either reading, only if its windows cover some of the item's literal words.  So
tables of numbers, dates and price lists are not taken for questions with numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.scratch import Scratch

WINDOW = 5
#: Items of fewer words have a single window; between it and three windows' length windows are a third of the item, so that one edited word leaves half of them.
WHOLE = 8
COVERAGE = 0.5
#: So many consecutive words are a leak, however long the item is.
RUN = 13
#: Least share of slot values that must map one to one; a single coincidence of values is let pass, unchanged values always.
CONSISTENT = 0.9
#: Literal words of the item that a place covers at least, or half of those that the item has, if that is less.
LITERAL = 3
#: Words of a document whose places for an item are judged together; bounds what is gathered for a very long one.
STRETCH = 4096
#: Rows of windows or findings that are broadcast at most; more of them are joined by shuffling.
BROADCAST_ROWS = 1_000_000
#: Windows of found places that are broadcast at most: some 10 MB.
BROADCAST_WINDOWS = 500_000
#: Hash positions between which an alignment may drift through inserted or removed words.
DRIFT = 4

UNITS = "km|m|cm|mm|miles|mile|feet|foot|inches|inch|yards|kg|g|mg|grams|gram|tons|ton|pounds|pound|lbs|ounces|ounce|litres|litre|liters|liter|ml|l|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|percent|dollars|dollar|euros|euro|cents|cent|degrees|degree|mph|kmh|gb|mb|kb|tb|volts|watts|hz"
NUMBER_WORDS = "two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million"
# markers of private use stand for the placeholders; no word can imitate them
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
VERBATIM, TEMPLATE = 0, 1
_WORD = r"\d+(?:[.,]\d+)*|[[\p{L}\p{M}\p{N}-]&&[^0-9]]+"
_NAME = r"^\p{Lu}\p{L}"


def _let(value: Column, body) -> Column:
    """body(value) with the value evaluated once; as a column of its own the optimizer may copy it into the lambdas of body."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    """The words as they stand; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(_WORD), 0)


def _is_number(word: Column) -> Column:
    return (word >= "0") & (word < ":")


def template_words(words: Column) -> Column:
    """Placeholders for names, numbers and units, other words in lower case."""

    def typed(w, i):
        low = F.lower(w)
        before = F.get(words, i - 1)
        unit = low.isin(UNITS.split("|")) & F.coalesce(_is_number(before) | F.lower(before).isin(NUMBER_WORDS.split("|")), F.lit(False))
        return F.when(_is_number(w) | low.isin(NUMBER_WORDS.split("|")), NUMBER).when(unit, UNIT).when((w != low) & w.rlike(_NAME), NAME).otherwise(low)

    return F.transform(words, typed)


def window_hashes(words: Column, widths: list[int]) -> Column:
    """For each word the hashes of the windows from it on, of each width in both readings.

    Windows that reach beyond the end meet no item's.
    """

    def windows(lower, typed):
        h = lambda c, reading, w, i: F.xxhash64(F.lit(2 * w + reading), *[F.get(c, i + k) for k in range(w)])
        return F.transform(lower, lambda _, i: F.array(*[h(c, reading, w, i) for w in widths for reading, c in ((VERBATIM, lower), (TEMPLATE, typed))]))

    return _let(words, lambda x: _let(_hashed(F.transform(x, lambda w: F.lower(w))), lambda v: _let(_hashed(template_words(x)), lambda t: windows(v, t))))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _width(n: Column, width: int) -> Column:
    return F.when(n < WHOLE, n).otherwise(F.least(F.floor((n + 1) / 3), F.lit(width))).cast("int")


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """(item, width, n_windows, reading, ipos, h) of each window of each item in both readings.

    A window of the template that has placeholders and too few literal words says nothing
    and is not matched, but counts among the item's windows.
    """
    b = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("words")).where("item is not null and size(words) > 0")
    b = b.select("item", "words", template_words(F.col("words")).alias("typed"), _width(F.size("words"), width).alias("width"))
    b = b.withColumn("n_windows", F.size("words") - F.col("width") + 1)
    lower = F.transform("words", lambda w: F.lower(w))
    b = b.select("item", "width", "n_windows", "typed", F.array(_hashed(lower), _hashed(F.col("typed"))).alias("both"))
    b = b.select("item", "width", "n_windows", "typed", F.posexplode("both").alias("reading", "hashes"))
    b = b.withColumn("ipos", F.explode(F.sequence(F.lit(0), F.col("n_windows") - 1)))
    part = F.slice("typed", F.col("ipos") + 1, F.col("width"))
    literal = F.size(F.filter(part, lambda w: ~w.isin(NAME, NUMBER, UNIT)))
    says = (F.col("reading") == VERBATIM) | (literal == F.col("width")) | (literal >= F.greatest(F.lit(1), F.floor(F.col("width") / 2)))
    # the hash of window_hashes, for a width that differs by row
    h = F.coalesce(*[F.when(F.col("width") == w, F.xxhash64(2 * F.lit(w) + F.col("reading"), *[F.get("hashes", F.col("ipos") + k) for k in range(w)])) for w in range(1, max(width, WHOLE) + 1)])
    return b.where(says).select("item", "width", "n_windows", "reading", "ipos", h.alias("h"))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    coverage: float = COVERAGE,
    consistent: float = CONSISTENT,
) -> DataFrame:
    """(id_col, item_col, n_matched, n_windows, coverage, n_slots, n_changed, consistency, kind) of each item found in a document.

    ``kind`` is ``verbatim`` if no slot value has changed, else ``parameterised``.

    * Null, empty or wordless texts and items match nothing; a null id of a document or an
      item is left out, for there is nothing to call the finding by.
    * Rows that repeat a document's id are one document; so are repeated items.
    * Short items of fewer than ``WHOLE`` words must occur whole.  An item of placeholders
      only, such as a list of numbers, is found only if it occurs whole and word by word.
    * An empty table on either side gives an empty result; other columns are not read.
    """
    items = item_windows(benchmark, item_col, item_text_col, width).dropDuplicates(["item", "width", "reading", "ipos", "h"])
    n = items.count()
    small = n <= BROADCAST_ROWS
    widths = sorted(r[0] for r in items.select("width").distinct().collect()) or [width]
    items = F.broadcast(items) if small else items
    d = docs.where(F.col(id_col).isNotNull())
    at = d.select(F.col(id_col).alias("doc"), F.posexplode(window_hashes(words_of(F.col(text_col)), widths)).alias("dpos", "hs")).select("doc", "dpos", F.explode("hs").alias("h"))
    hits = at.join(items, "h")
    # a place is one offset, or windows on nearly one offset; what is on the border of two bins counts in both
    offset = F.col("dpos") - F.col("ipos")
    bins = F.array(F.floor(offset / (2 * DRIFT)), F.floor((offset + DRIFT) / (2 * DRIFT)) + F.lit(1 << 40), offset + F.lit(1 << 41))
    key = ["doc", "item", "n_windows", "width", "reading", "bin"]
    placed = hits.select("doc", "item", "n_windows", "width", "reading", "ipos", offset.alias("offset"), F.explode(bins).alias("bin"))
    lines = placed.groupBy(*key, "offset").agg(F.sort_array(F.collect_set("ipos")).alias("at"))
    # the longest run of windows from word to word: a window further on in each step
    run = F.aggregate("at", F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("best")), lambda s, p: _step(s, p), lambda s: s.getField("best"))
    lines = lines.select(*key, "offset", F.size("at").alias("support"), run.alias("run"), F.explode("at").alias("ipos"))
    # each window of the item on the offset of most windows
    places = lines.groupBy(*key, "ipos").agg(F.max(F.struct("support", (-F.col("offset")).alias("o"))).alias("m"), F.max("run").alias("run"))
    places = places.groupBy(*key).agg(F.count("*").alias("n"), F.max("run").alias("run"), F.sort_array(F.collect_list(F.struct("ipos", (-F.col("m.o")).alias("offset")))).alias("at"))
    enough = (F.col("n") >= coverage * F.col("n_windows")) | (F.col("run") + F.col("width") - 1 >= RUN)
    places = places.where(enough).select("doc", "item", "n_windows", "width", "reading", "n", "at").distinct()
    words = words_of(F.col(item_text_col))
    literals = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.filter(F.transform(_let(words, template_words), lambda w, i: F.when(~w.isin(NAME, NUMBER, UNIT), i)), lambda i: i.isNotNull()).alias("literals"))
    places = places.join(F.broadcast(literals) if small else literals, "item")
    covered = F.size(F.filter("literals", lambda i: F.exists("at", lambda a: (a.getField("ipos") <= i) & (i < a.getField("ipos") + F.col("width")))))
    of = F.size("literals")
    said = F.when(of == 0, (F.col("reading") == VERBATIM) & (F.col("n") == F.col("n_windows"))).otherwise(covered >= F.least(F.lit(LITERAL), F.ceil(of / 2)))
    # one verbatim place settles its stretch of the document, and the item: its values are unchanged
    stretch = F.floor(F.element_at("at", 1).getField("offset") / STRETCH)
    places = places.where(said).groupBy("doc", "item", stretch.alias("stretch")).agg(
        F.max(F.when(F.col("reading") == VERBATIM, F.struct("n", "n_windows", "width", "at"))).alias("same"),
        F.collect_list(F.when(F.col("reading") == TEMPLATE, F.struct("n", "n_windows", "width", "at"))).alias("others"),
    )
    places = Scratch(docs.sparkSession).keep(places.select("doc", "item", F.when(F.col("same").isNotNull(), F.array("same")).otherwise(F.col("others")).alias("places"), F.col("same").isNotNull().alias("verbatim")), "decontaminate")
    # a place's windows are what makes it large
    windows = places.agg(F.sum(F.aggregate("places", F.lit(0), lambda n, p: n + F.size(p.getField("at")) + 1))).first()[0] or 0
    if windows <= BROADCAST_WINDOWS:
        places = F.broadcast(places)
    return _with_slots(docs, benchmark, places, id_col, text_col, item_col, item_text_col, consistent)


def _step(state: Column, at: Column) -> Column:
    n = F.when(at == state.getField("last") + 1, state.getField("n") + 1).otherwise(F.lit(1))
    return F.struct(at.alias("last"), n.alias("n"), F.greatest(n, state.getField("best")).alias("best"))


def _with_slots(docs, benchmark, places, id_col, text_col, item_col, item_text_col, consistent):
    """Compare the slots of every place; only texts with findings are read for it."""
    lower = lambda c: F.transform(c, lambda w: F.lower(w))
    d = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text")).join(places, "doc")
    d = d.select("doc", "item", "places", "verbatim", lower(words_of(F.col("_text"))).alias("dwords"))
    b = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("words"))
    slots = F.filter(F.transform(_let(F.col("words"), template_words), lambda w, i: F.when(w.isin(NAME, NUMBER, UNIT), i)), lambda i: i.isNotNull())
    both = d.join(b.select("item", lower("words").alias("iwords"), slots.alias("slots")), "item")

    def pairs(place, dwords, iwords, slots):
        """Of each slot within a matched window its value and the word that stands there in the document."""
        inside = lambda a, i: (a.getField("ipos") <= i) & (i < a.getField("ipos") + place.getField("width"))
        over = F.transform(slots, lambda i: F.struct(F.get(iwords, i).alias("of"), F.get(dwords, i + F.get(F.filter(place.getField("at"), lambda a: inside(a, i)), 0).getField("offset")).alias("to")))
        return F.filter(over, lambda p: p.getField("to").isNotNull())

    rows = lambda dw, iw, sl: F.transform("places", lambda p: F.struct(p.getField("n").alias("n"), p.getField("n_windows").alias("n_windows"), pairs(p, dw, iw, sl).alias("pairs")))
    each = _let(F.col("dwords"), lambda dw: _let(F.col("iwords"), lambda iw: _let(F.col("slots"), lambda sl: rows(dw, iw, sl))))
    both = both.select("doc", "item", "verbatim", F.explode(each).alias("p"))
    both = both.select("doc", "item", "verbatim", "p.n", "p.n_windows", "p.pairs").withColumn("maps", F.array_distinct("pairs"))
    # one to one: as many distinct pairs as distinct values on either side
    sides = F.size(F.array_distinct(F.transform("maps", lambda p: p.getField("of")))) + F.size(F.array_distinct(F.transform("maps", lambda p: p.getField("to"))))
    share = F.when(F.size("maps") == 0, 1.0).otherwise(sides / (2.0 * F.size("maps")))
    changed = F.size(F.filter("pairs", lambda p: p.getField("of") != p.getField("to"))).cast("long")
    rated = both.select("doc", "item", "n", "n_windows", F.size("pairs").cast("long").alias("n_slots"), changed.alias("n_changed"), share.alias("consistency"), (2 * F.size("maps") - sides).alias("clashes"), "verbatim")
    rated = rated.where(F.col("verbatim") | (F.col("n_changed") == 0) | (F.col("clashes") <= 1) | (F.col("consistency") >= consistent))
    out = rated.groupBy("doc", "item").agg(F.max(F.struct("verbatim", "n", "consistency", F.struct(-F.col("n_changed")), "n_windows", "n_slots", "n_changed")).alias("r"))
    return out.select(
        F.col("doc").alias(id_col),
        F.col("item").alias(item_col),
        F.col("r.n").cast("long").alias("n_matched"),
        F.col("r.n_windows").cast("long").alias("n_windows"),
        (F.col("r.n") / F.col("r.n_windows")).alias("coverage"),
        F.col("r.n_slots").alias("n_slots"),
        F.col("r.n_changed").alias("n_changed"),
        F.col("r.consistency").alias("consistency"),
        F.when(F.col("r.n_changed") > 0, "parameterised").otherwise("verbatim").alias("kind"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows in whose text no item is found, with all their columns.

    Rows are judged by their own text, so rows that share an id, or have none, are kept or
    dropped one by one; a null text has no words and stays.
    """
    key = F.xxhash64(F.col(text_col).cast("string"))
    texts = docs.select(key.alias("_key"), F.col(text_col).alias("_text"))
    found = find_contamination(texts, benchmark, "_key", "_text", **options).select(F.col("_key").alias("_found")).distinct()
    found = Scratch(docs.sparkSession).keep(found, "decontaminate-ids")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    return docs.join(found, key == found["_found"], "left_anti")

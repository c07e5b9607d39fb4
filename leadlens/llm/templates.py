"""Benchmark decontamination by template windows and slot consistency.

Texts become token sequences whose numbers, capitalised words and units behind
a number are replaced by typed placeholders, so a question asked again with
other numbers and names keeps its template.  A second form of the text, folded
to small letters, has placeholders for numbers only, so a copy in other letters
is met as well; either form counts.  Windows of ``WINDOW`` template
tokens (the whole item, if it is shorter) are hashed and joined with those of
the benchmark; windows that are mostly placeholders are left out.  Matching
windows of one document and item that lie at the same distance form an
alignment.  Its slots - the values behind the placeholders on both sides -
should stand in one-to-one correspondence: equal values are verbatim text,
consistently exchanged ones a re-parameterised question.  Anything else is a
chance meeting of templates, which counts for nothing, unless the alignment
holds ``WHOLE`` of the item's windows: then the question is there, edited (two
of its numbers made one, or one number of two changed).

Every token is hashed once; a window's hash combines those of its halves, down
to the tokens, so no window is ever spelled out.

The other alignments of a document and item are added up (a word put in or left
out starts a new one).  They are a leak if their windows are ``MIN_COVERAGE`` of
the item's, if their verbatim tokens are ``MIN_TOKENS`` of the item's, if one
of them holds ``VERBATIM_RUN`` verbatim tokens in a row, however long the item,
or if the text around one of them holds ``MIN_NEAR`` of the item's strings of
four tokens.

DataFrame functions only.  The benchmark's windows are broadcast behind a check
of their number; beyond it the join is a shuffle join on the window hash, which
AQE splits where a window is hot.  Texts are named by their MD5, so copies and
repeated ids do no harm.

Defined results: null, empty and too short texts match nothing; items without
a usable window match nothing; repeated rows each get their matches; empty
tables give an empty result; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import written
from leadlens.operators.joins import broadcast_if

WINDOW = 8
MIN_COVERAGE = 0.3
MIN_TOKENS = 0.5
VERBATIM_RUN = 13
MIN_NEAR = 0.5
WHOLE = 0.9
# windows of the benchmark (some 40 bytes each) and names of texts (16 bytes) that may be shipped to every task
BROADCAST_WINDOWS = 500_000
BROADCAST_TEXTS = 1_000_000
# unit words and symbols recognised behind a number (fixed values)
UNITS = ["mm", "cm", "dm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mi", "mile", "miles",
         "metre", "metres", "meter", "meters", "mg", "g", "kg", "t", "gram", "grams", "ton", "tons", "oz", "lb", "lbs", "pound",
         "pounds", "ml", "cl", "dl", "l", "litre", "litres", "liter", "liters", "gallon", "gallons", "s", "sec", "second", "seconds",
         "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
         "usd", "eur", "gbp", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees", "kmh", "mph"]
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"


def text_name(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


MARK = "\ue000"


def tokens(text: Column) -> Column:
    """Runs of letters or digits; a number with separators is one token, and a unit behind a
    number bears a mark (a private-use character, which texts lose first)."""
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    # the capital form of a sharp s is a double s
    bare = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit("")), F.lit("ß"), F.lit("ss"))
    joined = F.regexp_replace(bare, r"(\d)[.,](?=\d)", "$1")
    marked = F.regexp_replace(joined, rf"(\d)\s*((?i:{units}))(?![\p{{L}}\p{{N}}])", f"$1 {MARK}$2")
    parted = F.regexp_replace(marked, r"(\d)(?=\p{L})", "$1 ")
    return F.filter(F.split(parted, rf"[^\p{{L}}\p{{M}}\p{{N}}{MARK}]+"), lambda x: x != "")


def template(words: Column) -> Column:
    """The template token of each token.  Lambdas name nothing but their own element, so that
    no whole array is computed again for each element."""

    def of(x: Column) -> Column:
        low = F.lower(x)
        name = (low != x) & (F.length(x) > 1) & (F.initcap(x) == x)
        first = F.substring(x, 1, 1)
        number = first.between("0", "9") & x.rlike(r"^\d+$")
        # most tokens begin with a small letter and need no further look
        return F.when(first.between("a", "z"), low).when(name, NAME).when(number, NUMBER).when(first == MARK, UNIT).otherwise(low)

    return F.transform(words, of)


def folded(words: Column, pattern: Column) -> Column:
    """The token of each token in small letters; numbers stay placeholders."""
    return F.zip_with(words, pattern, lambda x, p: F.when(p == NAME, F.lower(x)).when(p == UNIT, F.lower(F.substring(x, 2, 1 << 20)))
                      .otherwise(p))


def _combined(a: Column, b: Column, shift: int) -> Column:
    """The hash of each element of ``a`` with the one of ``b`` that lies ``shift`` behind it."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, shift + 1, n), lambda x, y: F.xxhash64(x, y))


def window_hashes(df: DataFrame, columns: list[str], widths: list[int]) -> DataFrame:
    """``df`` with a column ``<column>_<width>`` for each: the hash of every window of ``width`` of the
    column's tokens, by place.  Each step is a projection of its own, since every array is used twice."""
    kept = list(df.columns)
    df = df.select(*kept, *[F.transform(c, lambda x: F.xxhash64(x)).alias(f"{c}_1_") for c in columns])
    span, have = 1, [1]
    while 2 * span <= max(widths):
        df = df.select("*", *[_combined(F.col(f"{c}_{span}_"), F.col(f"{c}_{span}_"), span).alias(f"{c}_{2 * span}_") for c in columns])
        span *= 2
        have.append(span)
    done = [F.col(c) for c in kept]
    for w in widths:
        for c in columns:
            # a width is the sum of powers of two, the largest first
            size = max(h for h in have if h <= w)
            got = F.col(f"{c}_{size}_")
            while size < w:
                step = max(h for h in have if h <= w - size)
                got = _combined(got, F.col(f"{c}_{step}_"), size)
                size += step
            done.append(got.alias(f"{c}_{w}"))
    return df.select(*done)


def _longest_run(places: Column) -> Column:
    """Length of the longest run of consecutive numbers in an array of distinct ones."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x == s["last"] + 1, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(places), start, step, lambda s: s["best"])


def _enough(min_coverage: float) -> Column:
    """Whether the alignments of a text and item (columns of ``_summed``) are a leak."""
    return ((F.col("windows") >= F.col("item_windows") * min_coverage)
            | ((F.col("typed") > 0) & (F.col("typed") >= F.col("item_typed") * min_coverage))
            | (F.col("tokens") >= F.col("item_tokens") * MIN_TOKENS) | (F.col("run") >= VERBATIM_RUN) | (F.col("near") >= MIN_NEAR))


def _fours(words: Column) -> Column:
    """Strings of four tokens, without a lambda, so that the array is not computed for each of them."""
    n = F.greatest(F.size(words) - 3, F.lit(0))
    return F.arrays_zip(*[F.slice(words, k, n) for k in range(1, 5)])


def _summed(alignments: DataFrame, *more: Column) -> DataFrame:
    """Per text and item: distinct windows and verbatim tokens of all alignments, the longest run of one."""
    union = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    return (alignments.groupBy("t", "item")
            .agg(union("places").alias("windows"), union("typed").alias("typed"), union("equal").alias("tokens"),
                 F.max(_longest_run(F.col("equal"))).alias("run"), F.max("near").alias("near"), F.first("item_windows").alias("item_windows"), F.first("item_typed").alias("item_typed"),
                 F.first("item_tokens").alias("item_tokens"),
                 *more))


def _plain(x: Column) -> Column:
    return F.translate(F.lower(x), MARK, "")


def _is_slot(x: Column) -> Column:
    return F.substring(x, 1, 1) == "<"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", window: int = WINDOW, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(t, item, windows, item_windows, kind): per text (by name) and item the windows of all
    alignments; kind is that of the largest one: verbatim, reparameterised or edited."""
    # -- benchmark windows
    words = tokens(F.col("text"))
    items = (benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("text is not null")
             .select("item", words.alias("item_words")).filter(F.size("item_words") > 0)
             .withColumn("item_pattern", template(F.col("item_words")))
             .withColumn("width", F.least(F.size("item_pattern"), F.lit(window))))
    items = written(items, "tpl-items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    items = items.withColumn("item_folded", folded(F.col("item_words"), F.col("item_pattern")))
    grams = None
    for w in widths:
        hashed = window_hashes(items.filter(F.col("width") == w).select("item", "item_pattern", "item_folded"), ["item_pattern", "item_folded"], [w])
        for c, typed in (("item_pattern", True), ("item_folded", False)):
            part = (hashed.select("item", c, F.posexplode(f"{c}_{w}").alias("item_at", "hash"))
                    .filter(F.size(F.filter(F.slice(c, F.col("item_at") + 1, w), lambda x: ~_is_slot(x))) * 2 >= w)
                    .select("item", F.lit(w).alias("width"), "item_at", "hash", F.lit(typed).alias("typed")))
            grams = part if grams is None else grams.unionByName(part)
    if grams is None:
        grams = items.limit(0).select("item", "width", F.lit(0).alias("item_at"), F.lit(0).cast("long").alias("hash"), F.lit(True).alias("typed"))
    # windows that read the same in both forms are one
    grams = grams.groupBy("item", "width", "item_at", "hash").agg(F.max("typed").alias("typed"))
    grams = written(grams, "tpl-windows")
    n_grams = grams.count()
    usable = grams.groupBy("item").agg(F.count_distinct("item_at").alias("item_windows"), F.count_if("typed").alias("item_typed"))
    # -- document windows meet them
    rows = docs.select(F.col(text_col).alias("text"))
    forms = (rows.withColumn("t", text_name(F.col("text"))).select("t", words.alias("words"))
             .select("t", "words", template(F.col("words")).alias("pattern"))
             .select("t", "pattern", folded(F.col("words"), F.col("pattern")).alias("folded")))
    widths = widths or [window]
    forms = window_hashes(forms, ["pattern", "folded"], widths)
    # the hash of the second form only where it differs
    both = lambda w: F.zip_with(f"pattern_{w}", f"folded_{w}",
                                lambda a, b: F.struct(a.alias("a"), F.when(a != b, b).alias("b")))
    # outer generators: an inner one is preceded by a filter that computes all arrays once more
    if len(widths) == 1:
        placed = forms.select("t", F.lit(widths[0]).alias("width"), both(widths[0]).alias("z"))
    else:
        each = F.array(*[F.struct(F.lit(w).alias("width"), both(w).alias("z")) for w in widths])
        placed = forms.select("t", F.explode_outer(each).alias("w")).select("t", "w.width", "w.z")
    met = (placed.select("t", "width", F.posexplode_outer("z").alias("at", "z"))
           .select("t", "width", "at", F.explode_outer(F.array("z.a", "z.b")).alias("hash")).filter("hash is not null")
           .join(broadcast_if(grams, n_grams, BROADCAST_WINDOWS), ["hash", "width"]))
    spots = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("width") - 1))))
    alignments = (met.groupBy("t", "item", (F.col("at") - F.col("item_at")).alias("shift"), "width")
                  .agg(F.collect_set("item_at").alias("places"), F.collect_set(F.when(F.col("typed"), F.col("item_at"))).alias("typed"))
                  .withColumn("spots", spots))
    sizes = usable.join(items.select("item", F.size("item_words").alias("item_tokens")), "item")
    alignments = written(alignments.join(F.broadcast(sizes) if n_grams <= BROADCAST_WINDOWS else sizes, "item"), "tpl-alignments")
    # -- slots of the few alignments
    names = alignments.select("t").distinct()
    few = (rows.withColumn("t", text_name(F.col("text")))
           .join(broadcast_if(names, alignments.count(), BROADCAST_TEXTS), "t", "left_semi").dropDuplicates(["t"])
           .select("t", words.alias("words")))
    told = (alignments.join(few, "t").join(items.select("item", "item_words", "item_pattern"), "item")
            .withColumnRenamed("shift", "start"))
    slots = F.transform(F.filter("spots", lambda i: _is_slot(F.get("item_pattern", i))),
                        lambda i: F.struct(_plain(F.get("item_words", i)).alias("x"),
                                           _plain(F.get("words", i + F.col("start"))).alias("y")))
    equal = F.filter("spots", lambda i: _plain(F.get("item_words", i)) == _plain(F.get("words", i + F.col("start"))))
    # the text around, half an item further on both sides
    begin = F.greatest(F.col("start") - F.floor(F.col("item_tokens") / 2).cast("int"), F.lit(0))
    around = F.transform(F.slice("words", begin + 1, F.col("item_tokens") * 2), _plain)
    fours = _fours(F.transform("item_words", _plain))
    pairs = F.array_distinct("slots")
    told = (told.withColumn("slots", slots).withColumn("equal", equal)
            .withColumn("near", F.size(F.array_intersect(fours, _fours(around))) / F.greatest(F.size(F.array_distinct(fours)), F.lit(1)))
            .withColumn("same", F.forall("slots", lambda s: s["x"].eqNullSafe(s["y"])))
            .withColumn("fits", (F.size(F.array_distinct(F.transform(pairs, lambda s: s["x"]))) == F.size(pairs))
                        & (F.size(F.array_distinct(F.transform(pairs, lambda s: s["y"]))) == F.size(pairs))))
    whole = F.size("places") >= F.col("item_windows") * WHOLE
    best = F.max(F.struct(F.size("places").alias("n"), "same", "fits")).alias("best")
    return (_summed(told.filter(F.col("same") | F.col("fits") | whole), best).filter(_enough(min_coverage))
            .select("t", "item", F.col("windows").cast("long").alias("windows"), "item_windows",
                    F.when(F.col("best.same"), "verbatim").when(F.col("best.fits"), "reparameterised").otherwise("edited").alias("kind")))


def leak_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item, windows, item_windows, kind: one row for each row of docs and item it leaks."""
    found = written(leaks(docs, benchmark, id_col, text_col, item_col, item_text_col), "tpl-leaks")
    rows = docs.select(F.col(id_col).alias("id"), text_name(F.col(text_col)).alias("t"))
    return (rows.join(broadcast_if(found, found.count(), BROADCAST_TEXTS), "t")
            .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "windows", "item_windows", "kind"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that leak no item, with all their columns."""
    found = written(leaks(docs, benchmark, id_col, text_col, item_col, item_text_col).select("t").distinct(), "tpl-leaking")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_name(F.col(f"`{text_col}`")).alias("t"))
    kept = rows.join(broadcast_if(found, found.count(), BROADCAST_TEXTS), "t", "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])

"""Benchmark decontamination by template windows.  DataFrame functions only.

A text becomes a sequence of template tokens: words in lower case, with numbers,
names (runs of capitalised words, but for the usual first words of sentences)
and units after numbers replaced by typed placeholders; two more forms have each
word of a name by itself, as a placeholder and, free of case, as a word.
Windows of WINDOW template tokens are hashed and joined with those of the
benchmark, so an item whose numbers and names were exchanged still matches.  A
window of placeholders alone says nothing, so it is hashed with its values.
Hits on one diagonal (text position less item position) belong to one copy of
the item.  The values in the slots of such a copy must be consistent: one value
of the item always becomes the same value in the text, and different values stay
different.  Where they are not, only windows that repeat the item word for word,
values included, count; and where nearly all of a copy are changed values, as in
tables of numbers, it is none.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from corpusloom.llm.runtime import materialise, partitions, unused

#: Template tokens of a window.
WINDOW = 5
#: A copy counts if its windows cover this part of the item's tokens, or so many tokens.
MIN_COVER, MIN_TOKENS = 0.5, 13
#: A copy keeps this part of the tokens that its windows cover; the others are slots whose values have changed.
MIN_KEPT = 1 / 3
#: Benchmark windows are broadcast up to so many bytes; beyond that both sides are shuffled.
BROADCAST_BYTES = 64 << 20
#: The keys of so many texts with copies are broadcast, so that only these texts are shuffled to read their slots.
BROADCAST_TEXTS = 500_000

# Units that are recognised after a number.
UNITS = "kg|g|mg|km|m|cm|mm|l|ml|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|years?|miles?|feet|inch(?:es)?|lbs?|usd|eur|dollars?|euros?|cents?|percent|mph|kmh"

# Words that begin a sentence with a capital and are no names (English, German, French, Spanish).
STARTERS = (
    "a about after all also although among an and another any are as at because before both but by can could did do does during each either every few find first for from given had has have he her here his how however i if in into is it its last let many may more most my neither no not now of often on once one only or other our out over she should since so some such suppose than that the their then there these they this those three through thus to two under until up was we were what when where whether which while who whom whose why will with without would yes you your "
    "aber alle als am an auch auf aus bei bis da damit dann das dass dem den denn der des die dies diese dieser dieses doch du durch ein eine einem einen einer er es für gegen hier ich ihr im in ist jede jeder kein keine man mit nach nicht noch nun nur ob oder ohne seit sie sind so um und unter viele vom von vor wann warum was weil welche welcher wenn wer wie wir wo während zu zum zur zwei "
    "au aucun aussi aux avec car ce ces cet cette chaque comme comment dans de des deux donc du elle elles en est et eux il ils je la le les leur lorsque mais même ne ni nous on ont ou où par pas plus pour pourquoi quand que quel quelle quelles quels qui sans se selon ses si son sont sous sur tous tout toute un une vous "
    "al algunos antes aunque cada como con cuando cuál cuánto cuántos de del desde donde dos durante él el ella ellos en entonces entre era es esa ese esta este esto estos fue ha hasta hay la las lo los más muy ni no nos o para pero por porque pues que qué quién se según ser si sin sobre son su sus también tiene todo todos tras un una uno y ya"
).split()

# Frequent small words of German, where every noun has a capital.
GERMAN = "der|die|das|und|ist|nicht|ein|eine|einem|einen|einer|dem|den|des|mit|von|zu|zum|zur|im|am|auf|für|wird|werden|sich|als|auch|sind|wie|aus|bei|nach"
#: Of a text's words so many, and so large a part, are GERMAN in a text whose capitals say nothing.
GERMAN_WORDS, GERMAN_PART = 2, 1 / 8

#: Near diagonals: chained copies may have up to so many tokens inserted or left out at one place.
SHIFT = 8

_NAME, _UNIT = "\x01", "\x02"
_WORD = r"\p{L}[\p{L}\p{M}]*"
# Forms of a text, as bits, since they agree where there are no names or no runs of them: a placeholder for a run of
# names, names as words, a placeholder for each word of a name.
_RUNS, _FREE, _APART = 1, 2, 4


def tokens(text: Column) -> Column:
    """Raw tokens in lower case; each word of a name starts with \\x01, a unit with \\x02, a number with a digit.

    A run of words of names is one token, its words one space apart.  A capital
    after a lower-case letter, a digit or a comma and one space makes a name;
    elsewhere, as at the start of a sentence, only in words other than STARTERS.
    In German texts no capital makes a name.
    """
    clean = F.replace(F.replace(text, F.lit(_NAME), F.lit(" ")), F.lit(_UNIT), F.lit(" "))
    starters = "|".join(sorted({w.capitalize() for w in STARTERS}))
    # the rare capital is looked for first
    inside = r"(?<=[\p{Ll}\p{Nd},;] )"
    small = F.regexp_count(clean, F.lit(rf"(?<![\p{{L}}\p{{M}}])(?:{GERMAN})(?![\p{{L}}\p{{M}}])"))
    german = (small >= GERMAN_WORDS) & (small >= F.regexp_count(clean, F.lit(r"\p{L}++")) * GERMAN_PART)
    named = F.regexp_replace(clean, rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{inside}|(?!(?:{starters})(?![\p{{L}}\p{{M}}])))", _NAME)
    named = F.when(german, clean).otherwise(named)
    unit = F.regexp_replace(F.lower(named), rf"([0-9] ?)(?={_NAME}?(?:{UNITS})(?![\p{{L}}\p{{N}}]))", f"$1{_UNIT}")
    # possessive groups are matched in a loop, others by a call for each word, which ends the stack in long runs
    return F.regexp_extract_all(unit, F.lit(rf"{_NAME}{_WORD}(?: {_NAME}{_WORD})++|{_NAME}?{_UNIT}?{_NAME}?{_WORD}|[0-9]+(?:[.,][0-9]+)*+"), F.lit(0))


def template(x: Column, free: bool = False) -> Column:
    """The placeholder of a number, name or unit; another token as it is.  ``free``: a name is its word."""
    # letters sort from "a" on, digits from "0", marks before both
    return F.when(x >= "a", x).when(x >= "0", F.lit("0")).when(F.contains(x, F.lit(_UNIT)), F.lit(_UNIT)).otherwise(F.translate(x, _NAME, "") if free else F.lit(_NAME))


def words(raw: Column) -> Column:
    """Tokens with the words of names by themselves, still marked."""
    return F.flatten(F.transform(raw, lambda x: F.split(x, " ")))


def bare(raw: Column) -> Column:
    """Tokens without the marks of names."""
    return F.transform(raw, lambda x: F.translate(x, _NAME, ""))


@lru_cache(maxsize=1)
def wordless(spark: SparkSession) -> tuple[int, ...]:
    """The hashes of windows that are placeholders alone."""
    tuples = product((F.xxhash64(F.lit(t)) for t in ("0", _UNIT, _NAME)), repeat=WINDOW)
    return tuple(spark.sql("SELECT 1").select(F.array(*[F.xxhash64(*t) for t in tuples])).first()[0])


def _window(of: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(of, i + k) for k in range(WINDOW)])


def windows(marked: Column, free: bool = False) -> Column:
    """Hashes of the windows of an array of marked tokens; none if it is shorter than a window."""

    def slide(each: Column) -> Column:
        return F.when(F.size(each) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(each) - WINDOW), lambda i: _window(each, i))).otherwise(F.array().cast("array<bigint>"))

    # as a lambda's variable an array is computed once, not once for every window
    return F.transform(F.array(F.transform(marked, lambda x: F.xxhash64(template(x, free)))), slide)[0]


def forms(raw: Column, blank: tuple[int, ...]) -> Column:
    """Array of (form, marked tokens, hashes of windows): one if the text has no names, two without runs of them, else three.

    Windows whose hash is in ``blank`` are hashed with their values instead.
    """

    def each(own: Column) -> Column:
        def form(bits: int, marked: Column, free: bool = False) -> Column:
            return F.struct(F.lit(bits).alias("form"), marked.alias("marked"), windows(marked, free).alias("hashes"))

        runs = F.array(form(_RUNS, own), form(_FREE, words(own), True), form(_APART, words(own)))
        single = F.array(form(_RUNS | _APART, own), form(_FREE, own, True))
        named = F.exists(own, lambda x: F.startswith(x, F.lit(_NAME)))
        return F.when(~named, F.array(form(_RUNS | _FREE | _APART, own))).when(F.exists(own, lambda x: F.contains(x, F.lit(" "))), runs).otherwise(single)

    def valued(f: Column) -> Column:
        hashes = F.transform(f["hashes"], lambda h, i: F.when(h.isin(*blank), _window(f["marked"], i)).otherwise(h))
        return F.struct(f["form"].alias("form"), f["marked"].alias("marked"), hashes.alias("hashes"))

    # as a lambda's variable the tokens are found once
    return F.transform(F.transform(F.array(raw), each)[0], valued)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a hash of the text; rows that agree in id and hash are copies."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))


def _known(windows_: DataFrame) -> DataFrame:
    """A table of benchmark windows, broadcast if it is small enough; a row counts as its id's length and 100 bytes."""
    size = windows_.agg(F.sum(F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)) + 100)).first()[0] or 0
    return F.broadcast(windows_) if size <= BROADCAST_BYTES else windows_


def _short_items(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """Texts that hold an item of fewer tokens than a window word for word, values included; as find_copies."""
    short = items.select("item_id", "item_key", bare(words(F.col("item_raw"))).alias("own")).withColumn("n", F.size("own")).where(f"n between 1 and {WINDOW - 1}")
    short = materialise(short.select("item_id", "item_key", "n", F.xxhash64("n", "own").alias("h")), "short-items")
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())  # WINDOW - 1 at most
    schema = {**{c: keyed.schema[c].dataType for c in ("doc_id", "text_key")}, "item_id": items.schema["item_id"].dataType}
    if not lengths:
        return keyed.sparkSession.createDataFrame([], StructType([*[StructField(c, t) for c, t in schema.items()], StructField("n_copies", LongType()), StructField("covered", DoubleType()), StructField("consistent", BooleanType())]))

    def at(own: Column, n: int) -> Column:
        return F.when(F.size(own) >= n, F.transform(F.sequence(F.lit(1), F.size(own) - n + 1), lambda i: F.xxhash64(F.lit(n), F.slice(own, i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))

    hashed = F.transform(F.array(bare(words(tokens(F.col("text"))))), lambda own: F.concat(*[at(own, n) for n in lengths]))[0]
    # copies of a row give the same places
    hits = keyed.select("doc_id", "text_key", F.posexplode(hashed).alias("place", "h")).join(_known(short), "h").distinct()
    return hits.groupBy("doc_id", "text_key", "item_id", "item_key").agg(F.count("*").alias("n_copies")).select("doc_id", "text_key", "item_id", "n_copies", F.lit(1.0).alias("covered"), F.lit(True).alias("consistent"))


def find_copies(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, short_items: bool = False, chained: bool = False) -> DataFrame:
    """One row per text and item found in it: doc_id, text_key, item_id, n_copies, covered, consistent.

    ``covered`` is the largest part of the item's tokens that one copy covers,
    ``n_copies`` the number of diagonals that count, ``consistent`` whether the
    best copy's slots agree throughout.  Null and empty texts hold nothing.
    Items shorter than a window have no template: with ``short_items`` they are
    found where a text repeats them word for word, else by nothing.  With
    ``chained`` windows without slots add up over diagonals that are up to SHIFT
    apart, so that copies with inserted or missing words count.  Texts and
    items of any length are read whole; a place of a text meets every place of
    the benchmark with the same window.  Rows with equal id and text are
    reported once; ``text_key`` (xxhash64 of the text) tells rows with equal ids
    apart.  Null item ids are kept apart by their text.  Further columns are
    ignored, empty tables give an empty result.
    """
    blank = wordless(docs.sparkSession)
    text = F.coalesce(benchmark[item_text_col], F.lit(""))
    items = benchmark.select(benchmark[item_col].alias("item_id"), F.xxhash64(text).alias("item_key"), tokens(text).alias("item_raw")).dropDuplicates(["item_id", "item_key"])
    # the benchmark is small beside the documents: few files
    items = items.coalesce(max(1, partitions(docs.sparkSession) // 16))
    items = items.select("item_id", "item_key", F.explode(forms(F.col("item_raw"), blank)).alias("f")).select("item_id", "item_key", F.col("f.form").alias("item_form"), F.col("f.marked").alias("item_raw"), F.col("f.hashes").alias("hashes"))
    items = materialise(items.withColumn("item_tokens", F.size("item_raw")), "benchmark-tokens")
    at = items.select("item_id", "item_key", "item_form", "item_tokens", "item_raw", F.posexplode("hashes").alias("item_at", "h"))
    at = materialise(at.select("h", "item_id", "item_key", "item_form", "item_tokens", "item_at", _slots_before(F.col("item_at")).alias("slots_from"), _slots_before(F.col("item_at") + WINDOW).alias("slots_to"), _literal(F.col("item_at")).alias("literal")), "benchmark-windows")
    known = _known(at)
    keyed = _keyed(docs, id_col, text_col)
    hashed = F.transform(forms(tokens(F.col("text")), blank), lambda f: F.struct(f["form"].alias("form"), f["hashes"].alias("hashes")))
    hits = keyed.select("doc_id", "text_key", F.explode(hashed).alias("f")).select("doc_id", "text_key", F.col("f.form").alias("doc_form"), F.posexplode("f.hashes").alias("doc_at", "h")).join(known, "h")
    hits = hits.withColumn("form", F.col("doc_form").bitwiseAND(F.col("item_form"))).where("form <> 0")
    copy = ["doc_id", "text_key", "item_id", "item_key", "item_form", "form", "diagonal"]
    hits = hits.select(*copy[:-1], "item_tokens", (F.col("doc_at") - F.col("item_at")).alias("diagonal"), "item_at", "slots_from", "slots_to", "literal").distinct()
    hits = materialise(hits, "benchmark-hits", compact=True)
    full = hits.groupBy(*copy, "item_tokens").agg(F.sort_array(F.collect_list("item_at")).alias("at"), F.sort_array(F.collect_list(F.when(F.col("slots_from") == F.col("slots_to"), F.col("item_at")))).alias("closed"), F.max(F.col("slots_from") < F.col("slots_to")).alias("open"), (F.max("slots_to") > F.min("slots_from")).alias("between"))
    full = full.withColumn("all", _covered(F.col("at"))).where(_counts(F.col("all")))
    full = materialise(full, "benchmark-copies", compact=True)
    # the slot values of a copy, read where the text is; only texts with a copy that has slots
    # in the case-free form names between windows count as well: exchanged ones break every window that they are in
    free = F.col("form") == _FREE
    asked = full.where(F.when(free, F.col("between")).otherwise(F.col("open"))).select(*copy, "at")
    raw_items = items.select("item_id", "item_key", "item_form", "item_raw")
    # texts without a copy are not shuffled, unless those with one are too many to broadcast
    texts = materialise(asked.select("doc_id", "text_key").distinct(), "benchmark-texts", compact=True)
    few = texts.count() <= BROADCAST_TEXTS
    slotted = _join_null_safe(keyed, F.broadcast(texts), ["doc_id", "text_key"], "left_semi") if few else keyed
    slots = (
        _join_null_safe(slotted, asked, ["doc_id", "text_key"])
        .withColumn("raw", tokens(F.col("text")))
        .drop("text")
        .withColumn("raw", F.when(free, bare(words(F.col("raw")))).when(F.col("form") == _APART, words(F.col("raw"))).otherwise(F.col("raw")))
        .transform(lambda x: _join_null_safe(x, raw_items, ["item_id", "item_key", "item_form"]))
        .withColumn("item_at", F.explode(F.when(free, F.sequence(F.get("at", F.lit(0)), F.element_at("at", -1) + WINDOW - 1)).otherwise(F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i, i + WINDOW - 1)))))))
        .select(*copy, "item_at", F.get("item_raw", F.col("item_at")).alias("then"), F.get("raw", F.col("item_at") + F.col("diagonal")).alias("now"), free.alias("free"))
        .where("then < 'a' and (then rlike '^[0-9]' or startswith(then, '\x01') or contains(then, '\x02'))")
        .withColumn("then", F.when(F.col("free"), F.translate("then", _NAME, "")).otherwise(F.col("then")))
    )
    changed = F.collect_set(F.when(~F.col("then").eqNullSafe(F.col("now")), F.col("item_at"))).alias("changed")
    sets = slots.groupBy(*copy).agg(changed, F.size(F.collect_set("then")).alias("a"), F.size(F.collect_set("now")).alias("b"), F.size(F.collect_set(F.struct("then", "now"))).alias("c"))
    verdict = sets.select(*copy, "changed", ((F.col("a") == F.col("c")) & (F.col("b") == F.col("c"))).alias("agrees"))
    judged = _join_null_safe(full, verdict, copy, "left").withColumn("consistent", F.coalesce("agrees", F.lit(True)))
    # windows that hold no changed value repeat the item word for word
    same = F.filter("at", lambda i: ~F.exists("changed", lambda c: (c >= i) & (c < i + WINDOW)))
    # tables of numbers agree in their few words: a copy of changed values alone is none
    inside = F.size(F.filter(F.coalesce("changed", F.array().cast("array<int>")), lambda c: F.exists("at", lambda i: (c >= i) & (c < i + WINDOW))))
    judged = judged.where(inside <= F.col("all") * (1 - MIN_KEPT))
    judged = judged.withColumn("same", F.when(F.col("consistent"), F.col("at")).otherwise(same)).withColumn("covered_tokens", _covered(F.col("same")))
    valued = F.size(F.array_except("same", "closed")) > 0
    judged = judged.where(F.col("consistent") | _counts(F.col("covered_tokens"), valued | (_longest(F.col("same")) >= MIN_TOKENS)))
    best = F.max(F.struct((F.col("covered_tokens") / F.col("item_tokens")).alias("covered"), "consistent"))
    # the forms see the same copies
    of_form = judged.groupBy("doc_id", "text_key", "item_id", "item_key", "item_form", "form").agg(F.count("*").alias("n_copies"), best.alias("best"))
    if chained:
        of_form = of_form.unionByName(_chains(hits))
    out = of_form.groupBy("doc_id", "text_key", "item_id", "item_key").agg(F.max("n_copies").alias("n_copies"), F.max("best").alias("best"))
    out = out.select("doc_id", "text_key", "item_id", "n_copies", F.col("best.covered").alias("covered"), F.col("best.consistent").alias("consistent"))
    return out.unionByName(_short_items(keyed, items.where(F.col("item_form").bitwiseAND(F.lit(_RUNS)) != 0))) if short_items else out


def _counts(covered: Column, telling: Column | None = None) -> Column:
    """Whether a copy counts; ``telling`` is a condition on MIN_TOKENS alone being enough."""
    enough = covered >= MIN_TOKENS if telling is None else (covered >= MIN_TOKENS) & telling
    return enough | ((covered >= F.col("item_tokens") * MIN_COVER) & (covered >= WINDOW))


def _covered(at: Column) -> Column:
    """Tokens that windows at the given ascending places cover."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(at, zero, lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])


def _longest(at: Column) -> Column:
    """Tokens of the longest stretch that windows at the given ascending places cover without a gap."""
    zero = F.struct(F.lit(0).alias("best"), F.lit(0).alias("n"), F.lit(-WINDOW - 1).alias("last"))

    def grow(s: Column, i: Column) -> Column:
        n = F.when(i - s["last"] <= WINDOW, s["n"] + i - s["last"]).otherwise(F.lit(WINDOW))
        return F.struct(F.greatest(s["best"], n).alias("best"), n.alias("n"), i.alias("last"))

    return F.aggregate(at, zero, grow, lambda s: s["best"])


def _literal(place: Column) -> Column:
    """Whether a window has no slot: no number or unit, and no name unless the form has names as words."""
    inside = F.slice("item_raw", place + 1, F.lit(WINDOW))
    free = F.col("item_form").bitwiseAND(F.lit(_FREE)) != 0
    return ~F.exists(inside, lambda x: F.when(free, F.translate(x, _NAME, "")).otherwise(x) < "a")


def _chains(hits: DataFrame) -> DataFrame:
    """Copies, as of each form, whose windows without slots lie on several near diagonals."""
    copy = ["doc_id", "text_key", "item_id", "item_key", "item_form", "form"]
    literal = hits.where("literal").select(*copy, "item_tokens", "diagonal", "item_at")
    along = Window.partitionBy(*copy).orderBy("diagonal")
    bands = literal.select(*copy, "diagonal").distinct().withColumn("new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > SHIFT, F.lit(True)).cast("int")).withColumn("band", F.sum("new").over(along)).drop("new")
    joined = _join_null_safe(literal, bands, [*copy, "diagonal"])
    together = joined.groupBy(*copy, "item_tokens", "band").agg(F.sort_array(F.collect_set("item_at")).alias("at"), F.count_distinct("diagonal").alias("diagonals")).where("diagonals > 1")
    counted = together.withColumn("all", _covered(F.col("at"))).where(_counts(F.col("all")))
    best = F.max(F.struct((F.col("all") / F.col("item_tokens")).alias("covered"), F.lit(True).alias("consistent")))
    return counted.groupBy(*copy).agg(F.count("*").alias("n_copies"), best.alias("best"))


def _slots_before(place: Column) -> Column:
    return F.size(F.filter(F.slice("item_raw", F.lit(1), place), lambda x: x < "a"))


def _join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"right_{c}") for c in on], *[c for c in right.columns if c not in on])
    condition = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"right_{c}"))
        condition = one if condition is None else condition & one
    return left.join(renamed, condition, how).drop(*[f"right_{c}" for c in on])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, short_items: bool = False, chained: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item, with all their columns.

    A row goes if ``find_copies`` finds an item in its text.  Null and empty
    texts stay, rows with null ids are judged by their own text, repeated rows
    go or stay together.  Texts of any length are read whole.  Columns of any
    names pass through.  An empty table stays empty, and an empty benchmark
    drops nothing.
    """
    found_id, found_key = unused(docs, "found_id", "found_key")
    found = find_copies(docs, benchmark, id_col, text_col, short_items=short_items, chained=chained).select(F.col("doc_id").alias(found_id), F.col("text_key").alias(found_key)).distinct()
    found = materialise(found, "contaminated", compact=True)
    mine = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found[found_id]) & (mine == found[found_key]), "left_anti")

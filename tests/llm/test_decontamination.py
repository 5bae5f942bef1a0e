import random
import re
import time

import regex
from pyspark.sql import functions as F

from corpusloom.llm.decontamination import SHIFT, STARTERS, UNITS, drop_contaminated, find_copies, tokens

ITEM = "If Tom has 5 apples and then Anna gives Tom 7 more apples after lunch, how many apples does Tom have and how far is 12 km really?"


def test_exchanged_slots_and_consistency(spark):
    items = [(1, ITEM), (2, None), (3, "short one"), (1, ITEM), (None, "one two three four five six seven")]
    swap = lambda *v: "Question: " + ITEM.replace("Tom", v[0]).replace("Anna", v[1]).replace("5", v[2]).replace("7", v[3]).replace("12", v[4]) + " Answer"
    wrong = swap("Bob", "Mary", "9", "3", "40").replace("does Bob", "does Dave")
    rows = [(1, swap("Bob", "Mary", "9", "3", "40.5"), 0), (2, wrong, 0), (3, None, 0), (4, "", 0), (4, "x", 0), (5, "nothing of that kind at all here", 0), (None, swap("Tom", "Anna", "5", "7", "12"), 0), (6, "(one) TWO, three... four! five six seven", 0), (1, "a clean text with the same id", 0), (7, ITEM + " " + ITEM, 0), (7, ITEM + " " + ITEM, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as h")
    got = sorted(((r.doc_id, r.item_id, r.n_copies) for r in find_copies(docs, bench).collect()), key=str)
    assert got == sorted([(1, 1, 1), (None, 1, 1), (6, None, 1), (7, 1, 2)], key=str)
    kept = drop_contaminated(docs, bench).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(2, wrong), (3, None), (4, ""), (4, "x"), (5, rows[5][1]), (1, rows[8][1])], key=str)
    assert find_copies(docs.limit(0), bench).collect() == [] and find_copies(docs, bench.limit(0)).collect() == []
    assert drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_lower_case_words_against_brute_force(spark):
    """Without names, numbers and units a copy is found exactly if windows of five words cover enough of the item."""
    random.seed(3)
    words = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "lnrt"]
    text = lambda n: [random.choice(words) for _ in range(n)]
    items = [(i, text(random.randint(3, 50))) for i in range(30)]
    docs = []
    for d in range(120):
        item = random.choice(items)[1]
        at = random.randrange(len(item))
        part = item[at : at + random.randint(1, 50)] if d % 3 else item
        if d % 5 == 0 and part:
            part = [*part[: len(part) // 2], "edit", *part[len(part) // 2 :]]
        docs.append((d, text(random.randint(0, 40)) + part + text(random.randint(0, 40))))

    def covers(doc, item):
        best = 0
        for shift in range(-len(item), len(doc)):
            cover = set()
            for p in range(len(item) - 4):
                if 0 <= p + shift and doc[p + shift : p + shift + 5] == item[p : p + 5]:
                    cover.update(range(p, p + 5))
            best = max(best, len(cover))
        return best >= 5 and (best >= 13 or best >= 0.5 * len(item))

    want = {(d, i) for d, doc in docs for i, item in items if covers(doc, item)}
    frame = lambda rows, key: spark.createDataFrame([(k, " ".join(t)) for k, t in rows], f"{key} long, text string")
    got = {(r.doc_id, r.item_id) for r in find_copies(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == want and len(want) > 50


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    plan = find_copies(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_inconsistent_copies_count_by_what_they_repeat(spark):
    long = "at noon Ada buys 3 red pens and 4 blue pens for the class while Ben sells 9 old books to Ada and keeps 2 of them at home for the next fair that opens in May"
    rows = [(1, ITEM.replace("does Tom", "does Dave")), (2, long.replace("to Ada", "to Zoe")), (3, "so at noon Ada buys 3 red pens and 4 blue pens for the class while Zoe sells 4 old books to Ada")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, ITEM), (2, long)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in find_copies(docs, bench).collect()}
    # 27 of 28 tokens are in windows that repeat the item
    assert (1, 1) in got and not got[1, 1].consistent and abs(got[1, 1].covered - 27 / 28) < 1e-9
    # a part of less than half is found by 13 tokens that hold values
    assert (2, 2) in got and (3, 2) in got and got[3, 2].covered < 0.5


def test_letter_case_and_names_of_other_lengths(spark):
    item = "In New York a train leaves for Los Angeles with 40 people, and in San Diego 12 of them leave it."
    other = item.replace("New York", "Paris").replace("Los Angeles", "Rome").replace("San Diego", "Milan").replace("40", "70").replace("12", "15")
    mixed = other.replace("Milan", "Paris")
    rows = [(1, item.lower()), (2, "we read: " + other), (3, item.lower().replace("40", "70").replace("12", "15")), (4, item), (5, "we read: " + mixed), (6, item.upper()), (7, "of all that, " + ITEM.lower().replace("tom", "bob")), (8, "Question: who built Los Angeles Town first")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, ITEM), (3, "who built New York City first")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in find_copies(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (6, 1), (7, 2), (8, 3)}
    assert all(got[k, 1].covered == 1 for k in (1, 2, 3, 4, 6)) and all(r.n_copies == 1 and r.consistent for r in got.values())


def plain_tokens(text):
    """(kind, word) of every token of a text, and its place; kinds are w, n(umber), N(ame), u(nit)."""
    out = []
    for m in regex.finditer(r"\p{L}[\p{L}\p{M}]*|[0-9]+(?:[.,][0-9]+)*", text):
        a, word = m.start(), m[0]
        if word[0].isdigit():
            kind = "n"
        elif regex.fullmatch(UNITS, word.lower()) and regex.search(r"[0-9] ?$", text[max(0, a - 2) : a]):
            kind = "u"
        elif regex.match(r"\p{Lu}\p{Ll}", word) and not regex.search(r"[\p{L}\p{M}\p{N}]$", text[:a]) and (regex.search(r"[\p{Ll}\p{Nd},;] $", text[max(0, a - 2) : a]) or word.lower() not in STARTERS):
            kind = "N"
        else:
            kind = "w"
        out.append((kind, word.lower(), a, m.end()))
    return out


def plain_forms(text):
    apart = [(k, w) for k, w, _, _ in plain_tokens(text)]
    runs, end = [], None
    for k, w, a, b in plain_tokens(text):
        if k == "N" and runs and runs[-1][0] == "N" and end == a - 1 and text[end] == " ":
            runs[-1] = ("N", runs[-1][1] + " " + w)
        else:
            runs.append((k, w))
        end = b
    if not any(k == "N" for k, _ in apart):
        return [(7, apart)]
    return [(1, runs), (2, apart), (4, apart)] if len(runs) < len(apart) else [(5, apart), (2, apart)]


def plain_find(text, item):
    """n_copies, covered, consistent of an item in a text, by looking at every diagonal; None if it is not in it."""
    best, most = None, 0
    for have, doc in plain_forms(text):
        for want, own in plain_forms(item):
            if not have & want:
                continue
            free = have & want == 2
            shown = lambda t: t[1] if t[0] == "w" or (free and t[0] == "N") else t[0]  # noqa: B023, E731
            n = 0
            for shift in range(-len(own), len(doc)):
                at = []
                for i in range(len(own) - 4):
                    if 0 <= i + shift and i + shift + 5 <= len(doc):
                        a, b = own[i : i + 5], doc[i + shift : i + shift + 5]
                        lit = any(t[0] == "w" or (free and t[0] == "N") for t in a)
                        if [*map(shown, a)] == [*map(shown, b)] and (lit or a == b):
                            at.append(i)
                cover = lambda at: {j for i in at for j in range(i, i + 5)}
                enough = lambda c: len(c) >= 5 and len(c) >= len(own) / 2  # noqa: B023, E731
                if not (enough(cover(at)) or len(cover(at)) >= 13):
                    continue
                spots = range(at[0], at[-1] + 5) if free else sorted(cover(at))
                pairs = [(j, own[j][1], doc[j + shift][1] if 0 <= j + shift < len(doc) else None) for j in spots if own[j][0] != "w"]
                one = {(a, b) for _, a, b in pairs}
                agrees = len(one) == len({a for a, _ in one}) == len({b for _, b in one})
                changed = {j for j, a, b in pairs if a != b}
                if 3 * len(changed & cover(at)) > 2 * len(cover(at)):
                    continue
                same = at if agrees else [i for i in at if not changed & set(range(i, i + 5))]
                got = cover(same)
                if not agrees and not enough(got):
                    runs = "".join("x" if j in got else " " for j in range(len(own))).split()
                    valued = any(own[j][0] != "w" for j in got)
                    if len(got) < 13 or not (valued or max(map(len, runs)) >= 13):
                        continue
                n += 1
                best = max(best or (0, False), (len(got) / len(own), agrees))
            most = max(most, n)
    return best and (most, *best)


def test_slots_against_brute_force(spark):
    random.seed(11)
    people, plain = ["Ada", "Ben", "New York", "Carl Otto", "Zoe", "Mia"], "buys sells red pens old books and then with many apples for more".split()

    def sentence():
        part = [random.choice(plain + people + ["#", "# km", "#kg"]).replace("#", str(random.randint(1, 9))) for _ in range(random.randint(3, 9))]
        if random.random() < 0.5:
            part[0] = random.choice(["The", "Alice", "Bob", "If"])
        return " ".join(part) + random.choice([".", ",", "?"])

    def changed(text):
        roll = random.random()
        if roll < 0.3:  # other values, one for one
            new = dict(zip(people, random.sample([*people, "Rome", "Los Angeles"], len(people)), strict=True)) | {"Alice": "Carol", "Bob": "Dave"}
            text = re.sub("|".join(new), lambda m: new[m[0]], text)
            text = re.sub("[0-9]", lambda m: str(10 + int(m[0])), text)
        elif roll < 0.5:  # any values
            text = re.sub("[0-9]", lambda m: str(random.randint(1, 9)), text)
        elif roll < 0.6:
            text = text.lower()
        elif roll < 0.7:
            text = text.replace("Ada", "Zoe", 1)
        words = text.split(" ")
        if random.random() < 0.3:
            words = words[random.randrange(len(words)) :]
        if random.random() < 0.2:
            words.insert(random.randrange(len(words) + 1), "edit")
        return " ".join(words)

    items = [" ".join(sentence() for _ in range(random.randint(1, 4))) for _ in range(25)]
    docs = [" ".join([sentence(), changed(random.choice(items)), *([changed(random.choice(items))] if random.random() < 0.3 else []), sentence()]) for _ in range(150)]
    want = {(d, i): found for d, doc in enumerate(docs) for i, item in enumerate(items) if (found := plain_find(doc, item))}
    frame = lambda rows, key: spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string")
    got = {(r.doc_id, r.item_id): (r.n_copies, r.covered, r.consistent) for r in find_copies(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    near = lambda x: (x[0], round(x[1], 9), x[2])
    assert {k: near(v) for k, v in got.items()} == {k: near(v) for k, v in want.items()}
    assert len(want) > 80 and {v[2] for v in want.values()} == {True, False}


def test_tables_of_numbers(spark):
    numbers = lambda n: [str(random.randint(0, 10**6)) for _ in range(n)]
    random.seed(5)
    listed, rows = numbers(200), [w for x in numbers(60) for w in ("row", x, x + "1", x + "2", x + "3")]
    docs = [(1, " ".join(numbers(4000))), (2, " ".join([*numbers(50), *listed[:120], *numbers(50)])), (3, "row " + " row ".join(" ".join(numbers(4)) for _ in range(70))), (4, " ".join(rows))]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    frame(docs, "doc_id").count()
    began = time.perf_counter()
    got = {(r.doc_id, r.item_id): r for r in find_copies(frame(docs, "doc_id"), frame([(1, " ".join(listed)), (2, " ".join(rows))], "item_id")).collect()}
    # lists of other numbers are no copies, and make no work; the same numbers are one
    assert set(got) == {(2, 1), (4, 2)} and got[2, 1].covered == 0.6 and got[4, 2].covered == 1
    assert time.perf_counter() - began < 60


def test_names_that_begin_sentences(spark):
    item = "Alice buys 5 apples. Carol sells 3 pears. Dave eats 2 plums."
    docs = [(1, "Zoe buys 7 apples. Max sells 4 pears. Tim eats 9 plums."), (2, "Zoe buys 7 apples. Max hides 4 nuts. Tim paints 9 walls."), (3, "The task. Alice buys 5 apples.\nCarol sells 3 pears. Dave eats 2 plums."), (4, "Then zoe buys 7 apples. max sells 4 pears. tim eats 9 plums.")]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = {r.doc_id: r for r in find_copies(frame(docs, "doc_id"), frame([(1, item)], "item_id")).collect()}
    assert set(got) == {1, 3} and got[1].covered == 1 and got[1].consistent


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "so what is 2 and 2? What is 2"), (2, "what is 3 and 2"), (3, "Paris"), (4, "paris paris"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "What is 2?"), (2, "Paris"), (3, ""), (4, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_copies) for r in find_copies(docs, bench, short_items=True).collect())
    assert got == [(1, 1, 2), (3, 2, 1), (4, 2, 2)] and find_copies(docs, bench).collect() == []
    assert sorted(str(r.doc_id) for r in drop_contaminated(docs, bench, short_items=True).collect()) == ["2", "None"]
    assert find_copies(docs, bench.where("item_id > 2"), short_items=True).collect() == []


def test_clashing_columns_and_long_texts(spark):
    long = "x" * 200_000 + " " + "word " * 50_000 + ITEM
    rows = [(1, ITEM, 1, 1, 1, 1), (2, long, 2, 2, 2, 2), (3, "x " * 100_000, 3, 3, 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found_id int, found_key int, __found_id int, item_id int")
    kept = drop_contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [3]
    assert drop_contaminated(docs.limit(0), docs.select("item_id", "text").limit(0)).collect() == []


def test_german_nouns_are_no_names(spark):
    bench = spark.createDataFrame([(1, "Die Hauptstadt der Republik ist die Stadt am Fluss."), (2, "Wie viele Äpfel hat der Bauer, wenn er 12 Äpfel mit dem Korb kauft und 5 davon isst?")], "item_id long, text string")
    docs = [(1, "Die Mutter der Tochter ist die Frau am Fenster."), (2, "Vorher. Die Hauptstadt der Republik ist die Stadt am Fluss."), (3, "Frage: Wie viele Äpfel hat der Bauer, wenn er 31 Äpfel mit dem Korb kauft und 9 davon isst?"), (4, "Wie viele Birnen hat der Vater, wenn er Bäume mit dem Wagen kauft und sie davon isst?")]
    got = {(r.doc_id, r.item_id) for r in find_copies(spark.createDataFrame(docs, "doc_id long, text string"), bench, chained=True).collect()}
    assert got == {(2, 1), (3, 2)}


def test_copies_with_inserted_and_missing_words(spark):
    item = "the quick farmer walks along river banks before sunrise and counts every grey heron that stands near shallow water under tall reeds today"
    words = item.split()
    put = lambda *at: " ".join(w for i, w in enumerate(words) for w in (["indeed", w] if i in at else [w]))
    docs = [(1, "Note: " + put(6, 12, 18) + " and more"), (2, " ".join(w for i, w in enumerate(words) if i not in (8, 15))), (3, " ".join(words[12:] + ["something", "else", "entirely", "follows", "here", "with", "many", "other", "words", "that", "fill"] + words[:6])), (4, " ".join(words[:6])), (5, " ".join(sorted(words)))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    plain = {r.doc_id for r in find_copies(frame.where("doc_id < 3"), bench).collect()}
    found = {r.doc_id: r.covered for r in find_copies(frame, bench, chained=True).collect()}
    assert set(found) - {3} == {1, 2} and found[1] == 1.0 and found[2] > 0.8 and plain <= {1, 2} and 1 not in plain


def test_chains_against_brute_force(spark):
    """Without slots a chained copy is one whose windows on diagonals within SHIFT of each other cover enough."""
    random.seed(8)
    words = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "lnrt"]
    text = lambda n: [random.choice(words) for _ in range(n)]
    items = [(i, text(random.randint(8, 40))) for i in range(20)]
    docs = []
    for d in range(80):
        part = list(random.choice(items)[1])
        for _ in range(random.randint(0, 5)):
            at = random.randrange(len(part) + 1)
            part[at:at] = ["edit"] * random.choice([1, 2, 12]) if random.random() < 0.7 else []
        docs.append((d, text(random.randint(0, 30)) + part + text(random.randint(0, 30))))

    def covers(doc, item):
        at = {}
        for p in range(len(item) - 4):
            for q in range(len(doc) - 4):
                if doc[q : q + 5] == item[p : p + 5]:
                    at.setdefault(q - p, set()).update(range(p, p + 5))
        bands = []
        for diagonal in sorted(at):
            if bands and diagonal - bands[-1][0] <= SHIFT:
                bands[-1] = (diagonal, bands[-1][1] | at[diagonal])
            else:
                bands.append((diagonal, set(at[diagonal])))
        best = max((len(c) for _, c in bands), default=0)
        return best >= 5 and (best >= 13 or best >= 0.5 * len(item))

    want = {(d, i) for d, doc in docs for i, item in items if covers(doc, item)}
    frame = lambda rows, key: spark.createDataFrame([(k, " ".join(t)) for k, t in rows], f"{key} long, text string")
    got = {(r.doc_id, r.item_id) for r in find_copies(frame(docs, "doc_id"), frame(items, "item_id"), chained=True).collect()}
    assert got == want and len(want) > 30


def test_long_runs_of_names_and_numbers(spark):
    """Runs of very many names or parts of a number are one token each, and the copy behind them is found."""
    names, number = "Anna Tom " * 20_000, "1" + ".25,7" * 20_000
    docs = spark.createDataFrame([(1, f"so {names}; {ITEM}"), (2, f"{number} {ITEM}"), (3, f"so {names}"), (4, number)], "doc_id long, text string")
    assert [r[0] for r in docs.orderBy("doc_id").select(F.size(tokens(F.col("text")))).collect()][2:] == [2, 1]
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in find_copies(docs, bench, short_items=True, chained=True).collect()) == [(1, 1), (2, 1)]

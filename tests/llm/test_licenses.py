import random
import re

from corpusloom.llm.licenses import BASE, MAX_GAP, MIN_COVER, MIN_RUN, NOTICES, find_licenses, scan, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def test_base_places_against_plain_search():
    random.seed(1)
    parts = ["cc", "by", "CC BY", "all", "rights", "reserved", "general", "public", "license", "gnu", "the", "é", "\u0085", " x ", "under", "licensed", "3", "-", "\u00a0"]
    for _ in range(4000):
        text = " ".join(random.choice(parts) for _ in range(random.randint(0, 30)))
        words = words_of(text)
        assert (len(words), find_licenses(words)[0]) == brute(text), text


def test_every_notice_is_found_whole_and_with_a_gap():
    for label, notice in NOTICES:
        words = notice.split()
        text = "some words before " + notice.upper() + ". And after"
        assert (3, 2 + len(words), label, 1.0) in find_licenses(words_of(text))[1]
        if len(words) > 14:
            cut = " ".join(words[:7] + ["strange", "insertion"] + words[8:])
            assert any(s[2] == label and s[3] < 1 for s in find_licenses(words_of(cut))[1])
    assert find_licenses(words_of("permission is hereby granted to nobody"))[1] == []


def test_rows(spark):
    rows = [(1, "All rights reserved. Released under the MIT License. ALL-RIGHTS-RESERVED", 1), (None, None, 2), (2, "", 3), (2, "", 3), (3, "w " * 100_000 + "licensed under cc by nc 4.0", 4)]
    got = sorted(scan(spark.createDataFrame(rows, "doc_id long, text string, score int")).collect(), key=str)
    one = next(r for r in got if r.doc_id == 1)
    assert (one.n_words, one.n_base, one.first_word, one.last_word, one.base_labels, one.labels, one.score) == (11, 2, 0, 8, "reserved", "mit,reserved", 1.0)
    long = next(r for r in got if r.doc_id == 3)
    assert (long.n_base, long.first_word, long.labels) == (1, 100_002, "cc-by,cc-by-nc-4.0")
    assert len(got) == 5 and all((r.n_words, r.n_base, r.first_word, r.labels, r.score) == (0, 0, None, "", 0.0) for r in got if r.doc_id in (None, 2))
    assert scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_spans(words):
    """Spans from matching statistics found by looking for every run in every notice."""
    notices = [t.split() for t, _ in BASE] + [t.split() for _, t in NOTICES]

    def ends(run):
        """Notice: the first place where the run ends in it."""
        found = {}
        for n, notice in enumerate(notices):
            at = [i + len(run) - 1 for i in range(len(notice) - len(run) + 1) if notice[i : i + len(run)] == run]
            if at:
                found[n] = at[0]
        return found

    longest = []
    for i in range(len(words)):
        n = (longest[-1] if longest else 0) + 1
        while n and not ends(words[i + 1 - n : i + 1]):
            n -= 1
        longest.append(n)
    chains, out = {}, {}

    def close(n, first, last, covered):
        part = covered / len(notices[n])
        if part >= MIN_COVER:
            key = (first, last, NOTICES[n - len(BASE)][0])
            out[key] = max(out.get(key, 0), part)

    for i, n in enumerate(longest):
        if n < MIN_RUN or (i + 1 < len(words) and longest[i + 1] == n + 1):
            continue
        start = i + 1 - n
        for k, end in ends(words[start : i + 1]).items():
            if k < len(BASE):
                continue
            if k in chains and start - chains[k][1] <= MAX_GAP and end > chains[k][2]:
                first, last, before, covered = chains[k]
                chains[k] = (first, i, end, covered + min(n, end - before, i - last))
            else:
                if k in chains:
                    first, last, _, covered = chains[k]
                    close(k, first, last, covered)
                chains[k] = (start, i, end, n)
    for k, (first, last, _, covered) in chains.items():
        close(k, first, last, covered)
    return sorted((*k, v) for k, v in out.items())


def test_spans_against_plain_matching_statistics():
    random.seed(6)
    found = 0
    for _ in range(250):
        words = []
        for _ in range(random.randint(1, 3)):
            notice = random.choice(NOTICES)[1].split()
            roll = random.random()
            if roll < 0.3:
                at = random.randrange(len(notice))
                notice = notice[:at] + random.choices(["x", "the", "license", "of"], k=random.randint(1, 10)) + notice[at + random.randint(0, 2) :]
            elif roll < 0.5:
                notice = notice[random.randrange(len(notice)) :]
            words += random.choices(["y", "the", "this", "software", "license", "z"], k=random.randint(0, 6)) + notice
        want = plain_spans(words)
        found += len(want)
        assert [(*s[:3], round(s[3], 9)) for s in find_licenses([w.encode() for w in words])[1]] == [(*s[:3], round(s[3], 9)) for s in want], words
    assert found > 200

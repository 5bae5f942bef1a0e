import random
import re

from pyspark.sql import functions as F

from corpusloom.llm.url_filter import MIN_LABELS, MIN_Z, PRIOR_LABELS, REJECT, STEPS, judge, shape

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URLS = [None, "", "x", "http://", "HTTP://A.Example.NET/en/1?x", "http://a.net", "http://a.net?q", "http://net/", "http://xnet/", "http://example.net/en/", "http://Ünet.org/fr/1#a", "a://b://c/d", "://host/p", "http://example.com/de/x\ny/z?#", "http://h/" + "a/" * 50, "http://u:p@h.org:80/fr/", "http://notexample.com/de/1", "\n\nhttp://q.com/de/1", "http://a.example.com/de"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([*enumerate(URLS), (3, "http://"), (None, None)], "page_id long, url string").selectExpr("*", "'x' as host", "1 as bad")
    got = judge(df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path = parts(URLS[r.page_id] if r.page_id is not None else None)
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name) and verdict in (None, r.verdict)
    assert judge(df.limit(0)).collect() == []


def plain_templates(urls):
    """The same trees with dictionaries: {(host, segments): (template, purity)}."""
    shapes = {}
    for host, path, bad in urls:
        segments = tuple(s for s in re.sub("[0-9]+", "{n}", path).split("/") if s)
        n, b = shapes.get((host, segments), (0, 0))
        shapes[(host, segments)] = (n + (bad is not None), b + (bad or 0))
    place = {key: "" for key in shapes}
    for level in range(8):
        live = [k for k in shapes if len(k[1]) > level]
        count = lambda f: [sum(shapes[k][i] for k in live if f(k)) for i in (0, 1)]
        moved = {}
        for k in live:
            same = lambda x: x[0] == k[0] and place[x] == place[k]  # noqa: B023, E731
            n, b = count(lambda x: same(x) and x[1][level] == k[1][level])  # noqa: B023
            all_n, all_b = count(same)
            rest_n, rest_b = all_n - n, all_b - b
            keep = n >= MIN_LABELS and rest_n == 0
            if n >= MIN_LABELS and rest_n and 0 < all_b < all_n:
                p = all_b / all_n
                keep = abs(b / n - rest_b / rest_n) > MIN_Z * (p * (1 - p) * (1 / n + 1 / rest_n)) ** 0.5
            moved[k] = place[k] + "/" + (k[1][level] if keep else "*")
        place |= moved
    overall = sum(b for _, b in shapes.values()) / max(1, sum(n for n, _ in shapes.values()))
    out = {}
    for k in shapes:
        own = [shapes[x] for x in shapes if x[0] == k[0] and place[x] == place[k]]
        out[k] = (place[k], (sum(b for _, b in own) + PRIOR_LABELS * overall) / (sum(n for n, _ in own) + PRIOR_LABELS))
    return out


def test_templates_against_plain_trees(spark):
    urls = [("a.com", f"/shop/{i}/x", 1) for i in range(8)] + [("a.com", f"/blog/{i}", 0) for i in range(9)] + [("a.com", f"/blog/new-{i}.html", None) for i in range(5)]
    urls += [("a.com", f"/shop/{w}/x", None) for w in ("red", "blue")] + [("b.com", f"/{w}", w > "d") for w in "abcdefg"] + [("b.com", "/", None), ("b.com", "", 0)] + [("c.com", "/only/1", None)]
    rows = [(i, f"http://{h}{p}", None if bad is None else int(bad)) for i, (h, p, bad) in enumerate(urls)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, label int"), rules=(), bad_col="label").collect()
    want = plain_templates([(h, p, None if b is None else int(b)) for h, p, b in urls])
    for r in got:
        host, path, _ = urls[r.page_id]
        template, purity = want[(host, tuple(s for s in re.sub("[0-9]+", "{n}", path).split("/") if s))]
        assert r.template == template and abs(r.purity - purity) < 1e-12
        assert r.verdict == ("block" if purity >= REJECT else "allow")
    assert {r.verdict for r in got if re.match("/shop/[0-9]", r.path)} == {"block"}
    # without labels of its own a branch joins the wildcard and is let through
    assert {r.verdict for r in got if r.path.startswith("/shop/red")} == {"allow"}


def test_only_evidence_of_their_own_rejects_templates(spark):
    rows = [f"http://bad.net/x/{i}" for i in range(30)] + [f"http://free.com/en/{i}" for i in range(9)] + [f"http://a.example.com/de/{i}" for i in range(2)] + [f"http://a.example.com/{w}/{i}" for w in ("en", "es") for i in range(9)]
    got = judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()
    # every label of the table is bad, but nothing is known of these hosts and branches
    assert {(r.host, r.verdict) for r in got if r.rule is None} == {("free.com", "allow"), ("a.example.com", "allow")}
    assert min(r.purity for r in got) == 1.0
    labelled = [(i, f"http://h.com/a/{i}", 1) for i in range(5)] + [(5, "http://h.com/a/5", None)] + [(i, f"http://g.com/{i}", 1) for i in (6, 7)] + [(8, "http://g.com/8", None)]
    got = judge(spark.createDataFrame(labelled, "page_id long, url string, bad int"), rules=(), bad_col="bad").collect()
    assert {r.verdict for r in got} == {"block"}


def test_variable_segments(spark):
    paths = {"/de/12.html": "/de/{n}", "/a/2024-01-31/x": "/a/{date}/x", "/v/20240131.pdf": "/v/{date}", "/x/550e8400-e29b-41d4-a716-446655440000.png": "/x/{uuid}", "/g/deadbeef01": "/g/{hex}", "/g/DEADBEEF01/": "/g/{hex}/", "/g/deadbeefab": "/g/deadbeefab", "/g/dGhpc0lzQW5JZDEy": "/g/{id}", "/blog/new-12.html": "/blog/new-{n}.html", "/v2/7": "/v{n}/{n}", "/": "/", "": "", "/12/12/12": "/{n}/{n}/{n}"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.s.replace("\x1f", "/") for r in df.select("p", shape(F.col("p")).alias("s")).collect()} == paths


def plain_verdicts(urls):
    """The trees of hosts and of all hosts together, with dictionaries: {(host, segments): (verdict, template, purity, basis)}."""
    counts = {}
    for host, path, bad in urls:
        key = (host, tuple(s for s in re.sub(r"(?<=/)[0-9]+(?:\.html)?(?=/|$)", "{n}", path).split("/") if s))
        n, b = counts.get(key, (0, 0))
        counts[key] = (n + (bad is not None), b + (bad or 0))

    def differ(n, b, m, c):
        p = (b + c) / (n + m)
        return 0 < p < 1 and abs(b / n - c / m) > MIN_Z * (p * (1 - p) * (1 / n + 1 / m)) ** 0.5

    def grow(leaves, at, level, out):
        """Places the leaves ({segments: (n, b)}) that agree so far, template ``at``."""
        branches = {}
        for segments, c in leaves.items():
            if len(segments) == level:
                out[segments] = at
            else:
                branches.setdefault(segments[level], {})[segments] = c
        total = {x: tuple(map(sum, zip(*own.values(), strict=True))) for x, own in branches.items()}
        steps = {}
        for x, (n, b) in total.items():
            if n >= MIN_LABELS:
                steps.setdefault(b * STEPS // n, []).append(x)
        groups = []
        for step in sorted(steps):
            n, b = (sum(total[x][i] for x in steps[step]) for i in (0, 1))
            if groups and not differ(*groups[-1][1:], n, b):
                groups[-1] = (groups[-1][0] + steps[step], groups[-1][1] + n, groups[-1][2] + b)
            else:
                groups.append((steps[step], n, b))
        names = {x: x if len(g[0]) == 1 else "*" if len(groups) == 1 else f"*{k + 1}" for k, g in enumerate(groups) for x in g[0]}
        merged = {}
        for x, own in branches.items():
            merged.setdefault(names.get(x, "*"), {}).update(own)
        for name, own in merged.items():
            grow(own, f"{at}/{name}", level + 1, out)

    whole = {}
    for (_, segments), (n, b) in counts.items():
        m, c = whole.get(segments, (0, 0))
        whole[segments] = (n + m, b + c)
    share = sum(b for _, b in counts.values()) / max(1, sum(n for n, _ in counts.values()))
    place, shared = {}, {}
    for host in {h for h, _ in counts}:
        out = {}
        grow({s: c for (h, s), c in counts.items() if h == host}, "", 0, out)
        place |= {(host, s): t for s, t in out.items()}
    grow(whole, "", 0, shared)
    result = {}
    for (host, segments), (n, _) in counts.items():
        own = [counts[k] for k, t in place.items() if k[0] == host and t == place[host, segments]]
        all_ = {k: c for k, c in counts.items() if shared[k[1]] == shared[segments]}
        every = list(all_.values())
        hosts = {h for (h, _), c in all_.items() if c[0]}
        basis, chosen, mine = "none", own, n
        if sum(x for x, _ in own):
            basis = "host"
        elif len(hosts) > 1 and sum(x for x, _ in every) >= MIN_LABELS:
            basis, chosen, mine = "shared", every, whole[segments][0]
        total, bad = (sum(c[i] for c in chosen) for i in (0, 1))
        purity = (bad + PRIOR_LABELS * share) / (total + PRIOR_LABELS)
        block = bad > 0 and (mine > 0 or total >= MIN_LABELS) and purity >= REJECT
        result[host, segments] = ("block" if block else "allow", place[host, segments] if basis != "shared" else shared[segments], purity, basis)
    return result


def test_trees_of_any_depth_against_plain_trees(spark):
    random.seed(2)
    urls = []
    for _ in range(900):
        host = f"h{min(random.randrange(8), random.randrange(8))}.com"
        segments = [random.choice("abcdef")] + [random.choice(["x", "y", str(random.randrange(3))]) for _ in range(random.choice([0, 1, 2, 3, 12]))]
        bad = random.random() < (0.9 if segments[0] in "ab" else 0.1 if segments[0] in "cd" else 0.5)
        urls.append((host, "/" + "/".join(segments) + random.choice(["", "", ".html", "/"]), None if random.random() < 0.4 or host == "h7.com" else int(bad)))
    # labels that only differ below the eighth level
    for k in range(12):
        urls += [("deep.com", "/s" * 9 + f"/{'good' if k % 2 else 'bad'}/{w}", 1 - k % 2) for w in "pq"]
    rows = [(i, f"http://{h}{p}", b) for i, (h, p, b) in enumerate(urls)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, label int"), rules=(), bad_col="label").collect()
    want = plain_verdicts(urls)
    for r in got:
        host, path, _ = urls[r.page_id]
        verdict, template, purity, basis = want[host, tuple(s for s in re.sub(r"(?<=/)[0-9]+(?:\.html)?(?=/|$)", "{n}", path).split("/") if s)]
        assert (r.verdict, r.template, r.basis) == (verdict, template, basis) and abs(r.purity - purity) < 1e-9
    assert {r.basis for r in got} == {"host", "shared", "none"} and len(got) == len(urls)
    assert {r.verdict for r in got if r.host == "deep.com" and "/bad/" in r.path} == {"block"}
    assert {r.verdict for r in got if r.host == "deep.com" and "/good/" in r.path} == {"allow"}
    assert {r.verdict for r in got if r.host == "h7.com"} == {"allow", "block"}


def test_similar_branches_share_a_wildcard(spark):
    rows = [(f"http://a.com/{'bad' if k % 2 else 'good'}{chr(97 + k % 26)}{chr(97 + k // 26)}/{i}", k % 2) for k in range(200) for i in range(4)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, bad int")
    got = judge(df, rules=(), bad_col="bad").collect()
    assert {(r.template, r.verdict) for r in got} == {("/*1/{n}", "allow"), ("/*2/{n}", "block")}
    assert all((r.verdict == "block") == bool(rows[r.page_id][1]) for r in got)


def test_hidden_hosts_and_unused_columns(spark):
    rows = [(1, "http://u:p@h.org/x#://net/", 1, "a"), (2, "http://a.net@b.com/x", 1, "b"), (3, "ftp://" + "a." * 2000 + "net/", 1, "c"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, tree int, shape string")
    got = {(r.page_id, r.rule) for r in judge(df).collect()}
    assert got == {(1, None), (2, None), (3, "net/"), (3, None)}


def test_very_deep_paths_take_as_many_rounds_as_branchings(spark, monkeypatch):
    from corpusloom.llm import url_filter

    written, real = [], url_filter.materialise
    monkeypatch.setattr(url_filter, "materialise", lambda df, label, **o: written.append(label) or real(df, label, **o))

    def tables(depth):
        written.clear()
        urls = [(f"http://h.com{'/s' * depth}/{side}{'/t' * depth}/{w}", side == "bad") for side in ("good", "bad") for w in "abcd" for _ in range(2)]
        df = spark.createDataFrame([(i, u, int(b)) for i, (u, b) in enumerate(urls)], "page_id long, url string, bad int")
        got = judge(df, rules=(), bad_col="bad").collect()
        assert {("/bad/" in r.path, r.verdict) for r in got} == {(True, "block"), (False, "allow")}
        assert {r.template for r in got if r.verdict == "block"} <= {f"{'/s' * depth}/bad{'/t' * depth}/{w}" for w in "abcd*"}
        return len(written)

    assert tables(500) == tables(3)

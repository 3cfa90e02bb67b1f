"""URL rules against brute force: given rules, and all token sets in place of FP-growth."""

import random
import re
import time
from collections import Counter
from itertools import combinations

from shelfmark.llm import urls
from tests.llm.helpers import table

SCHEMA = "page_id long, url string, host string, fit string, tokens string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def given(host, path):
    fit = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fit, key=lambda r: len(r[0]), default=None)


def tokens(url, host, path):
    clean = lambda x: re.sub("[0-9]+", "#", x.lower())
    query = re.search(r"\?([^#]*)", url or "")
    out = {"h:" + clean(x) for x in host.split(".") if x} | {"p:" + clean(x) for x in re.split("[/.]", path) if x}
    return frozenset(out | {"q:" + clean(x.split("=")[0]) for x in (query[1] if query else "").split("&") if x.split("=")[0]})


def slow(rows, support, confidence):
    parsed = [(i, u, *parts(u)) for i, u in rows]
    fits = [given(h, p) for _, _, h, p in parsed]
    labelled = [(tokens(u, h, p), f[3]) for (_, u, h, p), f in zip(parsed, fits) if f]
    counts, with_label = Counter(), Counter()
    for items, verdict in labelled:
        for n in range(1, len(items) + 1):
            for some in combinations(sorted(items), n):
                counts[some] += 1
                with_label[some, verdict] += 1
    rules = []
    for (some, verdict), n in with_label.items():
        if n / len(labelled) >= support and n / counts[some] >= confidence:
            rules.append((n / counts[some], len(some), n / len(labelled), " ".join(some), verdict))
    out = []
    for (i, u, h, p), fit in zip(parsed, fits):
        if fit:
            out.append((i, h, p, fit[0], fit[3]))
        else:
            mine = tokens(u, h, p)
            best = max((r for r in rules if set(r[3].split(" ")) <= mine), default=None)
            out.append((i, h, p, None, best[4] if best else urls.DEFAULT))
    return out


def judged(spark, rows, **options):
    df = table(spark, [(i, u, "x", "y", "z") for i, u in rows], SCHEMA)
    return [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, **options).collect()]


def test_rows_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        host = rng.choice(["a", "b", "www.c", "Spam-Farm"]) + ".example." + rng.choice(["org", "com", "net", "ORG"])
        path = rng.choice(["/en/1", "/en/25", "/de/", "/fr/3.html", "/es/9", "", "/x y"])
        rows.append((i, f"http://{host}{path}{rng.choice(['', '?page=2&ref=x', '#top', '?'])}"))
    rows += [(900, None), (901, ""), (902, "example.org/es/"), (903, "://"), (904, "x://ORG/"), (905, "x://notorg/"),
             (906, "x://a.org"), (None, "http://a.example.net/de/1"), (5, rows[5][1]), (907, "http://h.net/" + "a/" * 5000)]
    got = judged(spark, rows, support=0.02, confidence=0.8)
    order = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=order) == sorted(slow(rows, 0.02, 0.8), key=order)


def test_without_labels_and_empty(spark):
    assert judged(spark, []) == []
    assert judged(spark, [(1, "http://a.net/x"), (2, None)]) == [(1, "a.net", "/x", None, "allow"), (2, "", "", None, "allow")]


def test_tokens_that_go_together(spark):
    """Forty words that always stand together, and open urls that have some of them."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    shared = "/".join(words)
    rows = [(i, f"http://a{'bc'[i % 2]}.example.org/es/{shared if i % 2 else 'x/y'}/") for i in range(200)]
    rows += [(500, "http://h.net/" + "/".join(words[3:9])), (501, "http://h.net/x"), (502, "http://h.net/x/y/" + words[7]), (503, "http://h.net/q")]
    start = time.time()
    df = table(spark, [(i, u, "x", "y", "z") for i, u in rows], SCHEMA)
    got = {r.page_id: (r.verdict, r.mined) for r in urls.judge(df).where("page_id >= 500").collect()}
    assert time.time() - start < 60
    assert got == {
        500: ("block", " ".join(f"p:{w}" for w in words[3:9])), 501: ("block", "p:x"),
        502: ("block", " ".join(["p:x", "p:y"])), 503: ("allow", None),
    }


def test_some_tokens_that_go_together_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        top = rng.choice(["org", "com", "net"])
        path = rng.choice(["/de/a/b/c", "/fr/a/b/c/d", "/es/e/f", "/en/1/e/f/g", "/de/a", "/fr/k/e"])
        rows.append((i, f"http://h{rng.randrange(3)}x.{top}{path}{rng.choice(['', '/b/c', '?a=1&b=2'])}"))
    got = judged(spark, rows, support=0.02, confidence=0.6)
    assert sorted(got) == sorted(slow(rows, 0.02, 0.6))

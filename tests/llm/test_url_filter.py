"""URL filter: parts and rules against plain parsing, the model against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

pytest.importorskip("tracklake.llm")
from tracklake.llm import url_filter  # noqa: E402

URLS = ["http://a.example.net/en/1", "https://example.net/fr/x?y", "HTTP://WWW.Example.COM/de/#a", "http://myexample.com/de/", "http://x.org/fr/", "x.org/fr/", None, "", "http://", "ftp://net", "http://net/", "http://é.org/fr/?q=1", "http://a.org/FR/", "https://q.com/a://b.net/", "http://user@net:80/x"]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
    fits = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return host, path, max(fits, key=lambda r: len(r[1] + r[2])) if fits else None


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(k if k else None, u, "h") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = url_filter.judge(pages).collect()
    assert len(got) == 2 * len(URLS)
    want = {}
    for k, u in enumerate(URLS * 2):
        want[k or None] = plain(u)
    for r in got:
        host, path, rule = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1] + rule[2])
        assert r.verdict == (rule[0] if rule else r.verdict) and r.verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_model_learns_what_rules_block(spark):
    rows = [(k, f"http://casino-{k}.bet.net/win/{k}") for k in range(200)] + [(200 + k, f"http://school-{k}.learn.org/fr/book/{k}") for k in range(200)]
    rows += [(1000, "http://casino-77.bet.com/win/9"), (1001, "http://school-5.learn.uk/fr/book/7")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1000] == (None, "block") and got[1001] == (None, "allow")


def plain_verdicts(urls):
    """Verdicts of URLs by the same two models, from nested loops over characters."""
    rows = Counter(u for u in urls if u)
    said = {u: (plain(u)[2] or [None])[0] for u in rows}
    held = {u: hashlib.md5(u.encode()).hexdigest()[0] in "0123" for u in rows}
    folded = {u: "^^^" + re.sub("[^a-z0/.-]", "_", re.sub("[1-9]", "0", u.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)))) for u in rows}
    counts = {c: [Counter() for _ in range(5)] for c in ("allow", "block")}  # by length of the string
    for u, n in rows.items():
        if said[u] and not held[u]:
            for i in range(3, len(folded[u])):
                for k in range(5):
                    counts[said[u]][k][folded[u][i - k + 1 : i + 1] if k else ""] += n
    contexts = {c: [Counter() for _ in range(4)] for c in counts}
    for c, tables in counts.items():
        for k in range(1, 5):
            for gram, n in tables[k].items():
                contexts[c][k - 1][gram[:-1]] += n

    def chance(c, gram):
        if len(gram) == 1:
            return (counts[c][1][gram] + 1) / (counts[c][0][""] + 32)
        k, shorter = len(gram) - 1, chance(c, gram[1:])
        if sum(contexts[x][k][gram[:-1]] for x in contexts) < url_filter.MIN_CONTEXT:
            return shorter
        return (counts[c][k + 1][gram] + url_filter.WEIGHT * shorter) / (contexts[c][k][gram[:-1]] + url_filter.WEIGHT)

    bins = {}
    for u, f in folded.items():
        w = [math.log(chance("allow", f[i : i + 4])) - math.log(chance("block", f[i : i + 4])) for i in range(len(f) - 3)]
        bins[u] = math.floor(round(sum(w) / len(w), 9) * url_filter.BINS)
    calibration = [(bins[u], said[u], n) for u, n in rows.items() if held[u] and said[u]]
    total = Counter()
    for _, c, n in calibration:
        total[c] += n
    cut, best, prev = 0, None, None
    for b in sorted({b for b, _, _ in calibration}) if len(total) == 2 else ():
        below = Counter()
        for x, c, n in calibration:
            below[c] += n if x < b else 0
        good = 1.0 - below["allow"] / total["allow"] + below["block"] / total["block"]
        if best is None or good > best:
            cut, best = math.ceil((b + (b if prev is None else prev)) / 2), good
        prev = b
    return [said[u] or ("block" if bins[u] < cut else "allow") if u else "allow" for u in urls]


@pytest.mark.parametrize("ends", [(".net/", ".org/fr/", ".com/", ".io/Ä/"), (".com/",)])
def test_verdicts_equal_plain_models(spark, ends):
    rng = random.Random(len(ends))
    kinds = {e: [f"{a}{b}" for a in ("shop", "win", "learn", "news") for b in rng.sample("abcdefgh", 4)] for e in ends}
    urls = [f"http://{rng.choice(kinds[e])}{e}{rng.choice(kinds[rng.choice(ends)])}/{rng.randrange(999)}" for e in rng.choices(ends, k=900)]
    urls += rng.choices(urls, k=200) + ["http://long.com/" + "path/é" * 5000] + URLS
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(rows).collect()}
    want = plain_verdicts(urls)
    assert [got[k] for k in range(len(urls))] == want
    assert len(ends) == 1 or set(want) == {"allow", "block"}

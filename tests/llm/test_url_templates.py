import random
import re

import pytest

from quern.llm import queries, url_templates

PAGES = "page_id long, url string, verdict string"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules):
    fits = [(len(h + p), h + p, b) for h, p, b in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, key=lambda x: (-x[0], x[1], not x[2]), default=None)
    return (best[1], best[2]) if best else (None, None)


def plain_wildcard(seg):
    if seg == "":
        return seg
    m = re.search(r"(?<=.)\.[A-Za-z0-9]{1,5}$", seg)
    stem, end = (seg[: m.start()], ".*") if m else (seg, "")
    kind = "<number>" if re.fullmatch("[0-9]+", stem) else "<hex>" if re.fullmatch("(?=.*[0-9])[0-9A-Fa-f-]{8,}", stem) else "<word>" if re.fullmatch(r"(?:[^\W\d]|-)+", stem) else "<any>"
    return kind + end


def plain_judge(urls, rules):
    """The same by dicts in one process: (host, path, rule, verdict, template, purity) of each url."""
    rows = []
    for url in urls:
        host, path = plain_parts(url)
        rule, blocks = plain_rule(host, path, rules)
        rows.append({"host": host, "path": path, "rule": rule, "blocks": blocks, "segs": path.split("/")[1:], "parts": ()})
    for k in range(max((len(r["segs"]) for r in rows), default=0)):
        counts, nodes = {}, {}
        there = [r for r in rows if len(r["segs"]) > k]
        for r in there:
            node = (r["host"], r["parts"])
            nodes[node] = nodes.get(node, 0) + 1
            counts[node, r["segs"][k]] = counts.get((node, r["segs"][k]), 0) + 1
        for r in there:
            node, seg = (r["host"], r["parts"]), r["segs"][k]
            stays = counts[node, seg] >= 10 and counts[node, seg] >= 0.05 * nodes[node]
            r["next"] = r["parts"] + (seg if stays else plain_wildcard(seg),)
        for r in there:
            r["parts"] = r.pop("next")
    for k in range(max((len(r["parts"]) for r in rows), default=0) - 1, -1, -1):
        nodes = {}
        for r in rows:
            if len(r["parts"]) > k:
                f = nodes.setdefault((r["host"], r["parts"][:k]), {}).setdefault(r["parts"][k], {None: 0})
                for name in (None, ("next", r["parts"][k + 1] if len(r["parts"]) > k + 1 else None), ("label", r["blocks"])):
                    f[name] = f.get(name, 0) + 1
        renamed = {}
        for node, branches in nodes.items():
            classes = []
            for child in sorted(branches, key=lambda c: (-branches[c][None], c)):
                for names, sums in classes:
                    pooled = {f: (branches[child].get(f, 0), sums.get(f, 0)) for f in {*branches[child], *sums} - {None}}
                    m, n = branches[child][None], sums[None]
                    if all(abs(x / m - y / n) <= 2 * ((x + y) / (m + n) * (1 - (x + y) / (m + n)) * (1 / m + 1 / n)) ** 0.5 for x, y in pooled.values()):
                        names.append(child)
                        for f, v in branches[child].items():
                            sums[f] = sums.get(f, 0) + v
                        break
                else:
                    classes.append(([child], dict(branches[child])))
            for names, _ in classes:
                for child in names:
                    renamed[node, child] = child if len(names) == 1 else "{" + "|".join(sorted(names)) + "}"
        for r in rows:
            if len(r["parts"]) > k:
                r["parts"] = (*r["parts"][:k], renamed[(r["host"], r["parts"][:k]), r["parts"][k]], *r["parts"][k + 1 :])
    share = sum(r["blocks"] is True for r in rows) / max(len(rows), 1)
    out = []
    for r in rows:
        same = [x for x in rows if (x["host"], x["parts"]) == (r["host"], r["parts"])]
        purity = (sum(x["blocks"] is True for x in same) + 4 * share) / (sum(x["blocks"] is not None for x in same) + 4)
        blocks = r["blocks"] if r["blocks"] is not None else purity >= 0.8
        out.append((r["host"], r["path"], r["rule"], "block" if blocks else "allow", "/" + "/".join(r["parts"]) if r["parts"] else "", round(purity, 9)))
    return out


def judged(spark, urls, rules, **kwargs):
    pages = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls)], PAGES)
    found = url_templates.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, block boolean"), **kwargs).collect()
    assert len(found) == len(urls)
    return [(r["host"], r["path"], r["rule"], r["verdict"], r["template"], round(r["purity"], 9)) for r in sorted(found, key=lambda r: r["page_id"])]


ODD = [
    None, "", "no scheme", "http://", "http://HOST.COM", "https://www.Example.com/en/1?x=/#y", "a://b://c/d", "http://example.com:80/en/1", "http://notexample.com/en/1", "http://com/",
    "http://.com/", "http://example.com?/en/", "http://example.com#/en/", "http://example.com/en", "http://example.com//en/", "http://x.net/es/\n1", "http://É.net/fr/é", "http://x.net/" + "a/" * 30,
    "http://x.net/" + "z" * 100_000, "x://y.net/fr/1", "x://y.net/fr/1",
]


def test_odd_urls(spark):
    got = judged(spark, ODD, queries.URL_RULES)
    want = [(*plain_parts(u), plain_rule(*plain_parts(u), queries.URL_RULES)) for u in ODD]
    assert [(h, p, r) for h, p, r, *_ in got] == [(h, p, rule) for h, p, (rule, _) in want]
    assert all(v == ("block" if b else "allow") for (_, _, _, v, *_), (_, _, (_, b)) in zip(got, want, strict=True) if b is not None)


def test_an_empty_table_gives_no_rows(spark):
    assert judged(spark, [], queries.URL_RULES) == []


@pytest.mark.parametrize("seed", [1])
def test_equals_the_plain_version(spark, seed):
    rng = random.Random(seed)
    urls = []
    for host in ("a.net", "b.net", "c.org", "www.example.com", "d.com"):
        for _ in range(rng.randint(60, 200)):
            lang = rng.choice(["en", "en", "es", "fr", "de", f"s{rng.randint(0, 90)}"])
            urls.append(f"http://{host}/{lang}/{rng.randint(0, 999)}{rng.choice(['', '.html', '/', '/x/abc0123456'])}")
    urls += [u for u in ODD if u is None or len(u) < 50]
    rng.shuffle(urls)
    assert judged(spark, urls, queries.URL_RULES) == plain_judge(urls, queries.URL_RULES)


def test_a_template_that_labels_fill_is_rejected_and_its_neighbours_are_spared(spark):
    rules = [("net", f"/shop/item{k}.", True) for k in range(40)] + [("net", "/blog/", False)]
    bad, same = [f"http://x.net/shop/item{k}.html" for k in range(40)], [f"http://x.net/shop/other{k}a.html" for k in range(5)]
    good, free = [f"http://x.net/blog/{k}" for k in range(40)], [f"http://x.net/news/{k}" for k in range(60)]
    rows = judged(spark, bad + same + good + free, rules)
    assert [r[3] for r in rows] == ["block"] * 45 + ["allow"] * 100


def test_labels_of_pages_and_contradicting_rules(spark):
    pages = spark.createDataFrame([(k, f"http://x.org/p/{k}", 1 if k < 30 else None) for k in range(36)], "page_id long, url string, bad int")
    rules = spark.createDataFrame([("org", "/q/", True), ("org", "/q/", False)], "host string, path string, block boolean")
    assert {r["verdict"] for r in url_templates.judge_urls(pages, rules, label="bad").collect()} == {"block"}
    other = spark.createDataFrame([(1, "http://x.org/q/1")], "page_id long, url string")
    assert [(r["rule"], r["verdict"]) for r in url_templates.judge_urls(other, rules).collect()] == [("org/q/", "block")]

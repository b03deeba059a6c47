import itertools

import pytest

from termloom.llm import url_filter
from termloom.llm.catalog import URL_RULES

URLS = {
    None: ("", ""),
    "": ("", ""),
    "no scheme": ("", ""),
    "http://WWW.Example.COM/en/x?y#z": ("www.example.com", "/en/x"),
    "http://a.example.com/en/": ("a.example.com", "/en/"),
    "https://example.com?q=/en/": ("example.com", ""),
    "ftp://x.net/es/1#a/b": ("x.net", "/es/1"),
    "http://notnet/fr/": ("notnet", "/fr/"),
    "http://net/fr/": ("net", "/fr/"),
    "http://É.com/É": ("É.com", "/É"),
    "://a/b://c": ("a", "/b://c"),
    "http://a.org:80/en/\nx": ("a.org:80", "/en/\nx"),
}


def fixed(host: str, path: str):
    best = None
    for verdict, rule in URL_RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            best = max(best or ("", ""), (rule, verdict), key=lambda r: len(r[0]))
    return best


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([], "page_id long, block boolean")
    got = {r.page_id: r for r in url_filter.judge(pages, labels, URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, (host, path) in enumerate(URLS.values()):
        rule = fixed(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *(rule or (None, "allow")))


def test_mined_rules_against_all_combinations(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "LEAST_ROWS", 3)
    rows = []
    for i in range(120):
        host = ["spam.example", "good.example", "mixed.example"][i % 3] + ".org"
        rows.append((i, f"http://{host}/{['en', 'de', 'casino'][i // 3 % 3]}/p{i % 7}?x={i}"))
    block = {i: (i % 3 == 0 or (i % 3 == 2 and i // 3 % 3 == 2)) for i in range(100)}
    pages = spark.createDataFrame([*rows, (None, rows[0][1]), (0, rows[0][1])], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, b in block.items()] + [(5, None), (None, True)], "page_id long, block boolean")
    host, path = url_filter.host_and_path(pages["url"])
    held = {r.url: frozenset(r.tokens) for r in pages.select("url", url_filter.tokens(host, path).alias("tokens")).collect()}
    labelled = [(held[rows[i][1]], b) for i, b in block.items()] + [(held[rows[0][1]], block[0])]
    counts: dict[frozenset, list[int]] = {}
    for own, bad in labelled:
        for n in range(1, len(own) + 1):
            for some in itertools.combinations(sorted(own), n):
                counts.setdefault(frozenset(some), [0, 0])[bad] += 1
    rules = [s for s, (good, bad) in counts.items() if bad >= 3 and bad >= 0.7 * (good + bad)]
    assert rules
    got = url_filter.judge(pages, labels, []).collect()
    assert len(got) == len(rows) + 2
    by_host = {(r.host, r.path): r.verdict for r in got}
    for _, url in rows:
        want = "block" if any(s <= held[url] for s in rules) else "allow"
        name = url.removeprefix("http://").partition("/")[0]
        assert by_host[name, url.removeprefix("http://" + name).partition("?")[0]] == want


@pytest.mark.parametrize("block", [None, True, False])
def test_labels_of_one_kind(spark, block):
    pages = spark.createDataFrame([(i, "http://a.org/b") for i in range(30)], "page_id long, url string")
    labels = spark.createDataFrame([(i, block) for i in range(30)], "page_id long, block boolean")
    verdicts = {r.verdict for r in url_filter.judge(pages, labels, []).collect()}
    assert verdicts == {"block" if block else "allow"}
    assert url_filter.judge(pages.limit(0), labels, []).collect() == []


def test_templates_of_many_shared_tokens(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "LEAST_ROWS", 5)
    shared = "/".join(f"part{i}" for i in range(30))
    rows = [(i, f"http://{'bad' if i % 2 else 'fine'}.org/{shared}/{'casino' if i % 2 else 'news'}/{i}") for i in range(60)]
    # Pages of one kind hold two words together that are harmless alone.
    rows += [(100 + i, f"http://mixed.net/{['aa/bb', 'aa', 'bb', 'cc'][i % 4]}/x{i}") for i in range(80)]
    labels = [(i, bool(i % 2)) for i in range(60)] + [(100 + i, i % 4 == 0) for i in range(80)]
    more = [(200, f"http://other.org/{shared}/z"), (201, "http://other.org/casino"), (202, "http://other.org/bb/q/aa"), (203, "http://other.org/aa/q")]
    pages = spark.createDataFrame(rows + more, "page_id long, url string")
    known = spark.createDataFrame(labels, "page_id long, block boolean")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, known, []).collect()}
    want = {i: "block" if bad else "allow" for i, bad in labels}
    assert got == want | {200: "allow", 201: "block", 202: "block", 203: "allow"}

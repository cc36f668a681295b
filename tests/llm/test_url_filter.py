from __future__ import annotations

from tallyloom.llm.url_filter import filter_urls

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.org", "/x", "block"), ("a.org", "", "allow"),
         ("b.org", "/same", "allow"), ("b.org", "/same", "block"))
PAGES = "page_id long, url string, host string, verdict int"


def _judged(table, *urls, rules=RULES):
    pages = table(PAGES, *((n, u, "clash", 7) for n, u in enumerate(urls)))
    rows = filter_urls(pages, table("host string, path string, action string", *rules)).orderBy("page_id").collect()
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows]


def test_rules_and_precedence(table):
    assert _judged(table, "http://X.Example.NET/en/1?q#f", "https://example.net/de", "http://example.net", "http://notnet/",
                   "http://www.a.org/xyz", "http://a.org?x", "ftp://b.org/same/1") == [
        ("x.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/de", "net/", "block"),
        ("example.net", "", None, "allow"), ("notnet", "/", None, "allow"),
        ("www.a.org", "/xyz", "a.org/x", "block"), ("a.org", "", "a.org", "allow"), ("b.org", "/same/1", "b.org/same", "block")]


def test_odd_urls(table):
    long = "http://net/" + "a/" * 20000
    judged = _judged(table, None, "", "no scheme", "http://", "http:///net/", "http://net\n/x", long, long)
    assert judged[:5] == [("", "", None, "allow")] * 3 + [("", "", None, "allow"), ("", "/net/", None, "allow")]
    assert judged[5][0] == "net\n" and judged[6] == judged[7] and judged[6][2:] == ("net/", "block")


def test_no_rules_and_no_pages(table):
    assert _judged(table, "http://net/", rules=()) == [("net", "/", None, "allow")]
    assert _judged(table) == []
    assert _judged(table, "http://net/", rules=((None, "/", "block"), ("", "", "block"), ("net", None, "block"))) == [("net", "/", "net", "block")]


def test_against_brute_force(table):
    hosts, paths = ["net", "a.net", "b.a.net", "org", "x.org"], ["", "/", "/a", "/a/b/", "/a/bc"]
    urls = [f"http://{h}{p}" for h in ("net", "q.a.net", "b.a.net", "xorg", "x.org") for p in ("", "/", "/a", "/a/b/c", "/a/bcd")]
    rules = [(h, p, "block" if (i + j) % 2 else "allow") for i, h in enumerate(hosts) for j, p in enumerate(paths)]

    def best(url):
        host, path = url[7:].split("/", 1)[0], url[7 + len(url[7:].split("/", 1)[0]):]
        fit = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (max(fit)[3], max(fit)[4]) if fit else (None, "allow")

    assert [r[2:] for r in _judged(table, *urls, rules=rules)] == [best(u) for u in urls]

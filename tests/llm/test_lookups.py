import numpy as np
import pytest

from veristrand.llm import license_scan, license_texts, url_filter

URLS = [
    "http://a.example.com/en/1", "https://www.Example.com/en/?q", "https://x.www.example.com/en/2#top", "ftp://shop.net/es/", "shop.net/es/", None, "", "http://net/fr/a", "http://botnet/fr/",
    "http://example.com", "http://example.com?x=/en/", "http://u@h.org:80/a?b#c", "x://://com/", "http://É.com/Ü", "http://com./en/", "http://" + "a." * 300 + "example.com/en/" + "p" * 5000, "http://a.example.com/en/1",
]


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("rules", [url_filter.RULES, [], [("block", "com", "/"), ("allow", "com", "/"), ("block", "org", ""), ("block", "example.com", "/e")]])
def test_urls(spark, rules):
    df = spark.createDataFrame([(i % 16, u, "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, hits int")
    got = sorted(str(tuple(r)) for r in url_filter.judge(df, url_filter.rule_table(spark, rules)).collect())
    once = {}
    for v, h, p in rules:
        once[h, p] = max(v, once.get((h, p), ""))
    want = sorted(str((i % 16, *judge(u, [(v, h, p) for (h, p), v in once.items()]))) for i, u in enumerate(URLS))
    assert got == want


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    from pyspark.sql import functions as F

    entries = spark.range(5000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("r_host"), F.lit("/").alias("r_path"))
    lanes = url_filter.bloom(entries)
    keys = spark.range(20000).select(*url_filter._key(F.concat(F.lit("h"), F.col("id").cast("string")), F.lit("/"))).toPandas().to_numpy()
    met = url_filter.may_hold(lanes, keys[:, 0], keys[:, 1])
    assert met[:5000].all() and met[5000:].mean() < 0.02
    assert not url_filter.may_hold(np.zeros((1, 8), dtype=np.uint64), keys[:5, 0], keys[:5, 1]).any()


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(df, url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def test_licences(spark, docs_of):
    full = dict(license_texts.TEXTS)["0BSD"]
    rows = [
        (1, "released UNDER the mit license"), (2, "some text\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0.\n(c) 2020 me"), (3, f"Copyright 2021 Someone\n{full.upper()}"), (4, None), (5, ""),
        (6, "Released under the MIT License. More."), (7, "x " * 100_000), (2, "other"), (1, "released UNDER the mit license"), (None, "Licensed under CC BY 4.0"),
    ]
    got = sorted(((r["doc_id"] or -1, r["license"], r["notices"]) for r in license_scan.scan(docs_of(rows), license_scan.known_digests(spark)).collect()), key=str)
    want = [(1, "MIT", "MIT"), (1, "MIT", "MIT"), (2, None, "CC-BY-NC-4.0,MIT"), (2, None, ""), (3, "0BSD", ""), (4, None, ""), (5, None, ""), (6, None, ""), (7, None, ""), (-1, "CC-BY-4.0", "CC-BY-4.0")]
    # the notice of line 3 is a licence of one line once its copyright line is gone
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want, key=str)]
    assert {g for g in got if g[0] not in (3,)} == {w for w in want if w[0] != 3}
    assert license_scan.scan(docs_of([]), license_scan.known_digests(spark)).count() == 0
    assert license_scan.scan(docs_of(rows), license_scan.known_digests(spark, [])).where("license is not null").count() == 0


def test_whole_licence_texts(spark, docs_of, tmp_path):
    mit = dict(license_texts.TEXTS)["MIT"]
    rows = [(1, f"The MIT License (MIT)\n\nCopyright (c) 2020 Someone\n\n{mit}"), (2, mit.replace(" ", "\n")), (3, mit + " More."), (4, "My own licence: be\nkind.")]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(docs_of(rows), license_scan.known_digests(spark)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None}
    assert {r["license"] for r in license_scan.scan(docs_of([(1, f"Copyright {w} x\n{mit}") for w in ("2020", "(c)", "© 1999-2020", "by 2001", "Someone")]), license_scan.known_digests(spark)).collect()} == {"MIT"}
    (tmp_path / "Own-1.0.txt").write_text("Copyright me\nMY OWN LICENSE; be kind")
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(docs_of(rows), license_scan.known_files(spark, str(tmp_path))).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "Own-1.0"}


def test_every_wrap_of_every_text(spark, docs_of):
    """A licence is found wherever one of its spaces is a line's end, with a title and a copyright line above."""
    rows, want = [], {}
    for name, text in license_texts.TEXTS:
        at = [i for i, c in enumerate(text) if c == " "]
        for nth, i in enumerate(at):
            wrapped = f"{text[:i]}\n{text[i + 1 :]}"
            if nth % 5 == 0:
                wrapped = f"{license_texts.TITLES[name][0]}\n\nCopyright (c) 2020, Some One and others\nAll rights reserved.\n\n{wrapped}"
            want[len(rows)] = name
            rows.append((len(rows), wrapped))
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(docs_of(rows), license_scan.known_digests(spark)).collect()}
    assert got == want and len(rows) > 1000


def test_digests_of_longer_licences(spark, docs_of):
    """The digest table holds what its texts give, where this machine has them."""
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    here = [(i, n, (folder / f).read_text()) for i, (f, n) in enumerate(names.items()) if (folder / f).exists()]
    if not here:
        pytest.skip("no licence texts here")
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(docs_of([(i, t.replace("  ", " ").upper() if i % 2 else t) for i, _, t in here]), license_scan.known_digests(spark)).collect()}
    assert got == {i: n for i, n, _ in here}


def test_licence_of_a_very_long_text(spark, docs_of):
    rows = [(1, "word " * 600_000), (2, "Licensed under the MIT License.\n" * 100_000)]
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in license_scan.scan(docs_of(rows), license_scan.known_digests(spark)).collect()}
    assert got == {1: (None, ""), 2: (None, "MIT")}

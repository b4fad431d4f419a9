"""Cuts and arrangements against a plain restatement, and the exact way back."""

import hashlib
import re

from pyspark.sql import functions as F

from veristrand.llm import fill_middle

TEXTS = [None, "", "\n", "one line", "a\nb\nc\n", "a\n\n\nb", "has <P> in it\nx", "half <P\n>S> ok\n<", "tail <M>", "ü\nß€\n\U0001f600 x\n", "x\r\ny\r\n", "z\n" * 300, "long " * 60_000 + "\nend"]


def plain(doc_id, text, rate=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < suffix_first:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_report(docs_of):
    rows = [(i * 37 + k, t) for k in range(12) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc"), (5, "p\nq\n"), (5, "p\nq\n"), (-3, "m\nn")]
    got = sorted(map(tuple, fill_middle.fim_report(docs_of(rows)).collect()), key=str)
    want = []
    for d, t in rows:
        *first, out = plain(d, t)
        want.append((d, *first, sha(out), sha(t or "")))
    assert got == sorted(want, key=str) and {r[2] for r in got} == {"plain", "psm", "spm"}


def test_general_use(docs_of):
    """Own units, rates and sentinels; all columns stay, and the way back is exact."""
    rows = [(i, f"w{i} x y z " * (i % 7)) for i in range(60)]
    signs = ("[A]", "[B]", "[C]")
    out = fill_middle.arrange(docs_of(rows), seed=3, rate=60, suffix_first=30, unit=r"\S+\s*", sentinels=signs)
    back = out.withColumn("back", fill_middle.restore(F.col("form"), F.col("arranged"), signs)).collect()
    assert {r["doc_id"]: r["back"] for r in back} == dict(rows) and all(r["size"] == 7 and r["h"] == 7 for r in back)
    plain_ones = [r for r in back if r["form"] == "plain" and r["text"]]
    assert 5 < len(plain_ones) < 40 and all(r["prefix"] + r["middle"] + r["suffix"] == r["text"] for r in back if r["form"] != "plain")


def test_empty_and_native(docs_of):
    report = fill_middle.fim_report(docs_of([(1, "a")]).limit(0))
    assert report.count() == 0
    assert "Python" not in report._jdf.queryExecution().executedPlan().toString()

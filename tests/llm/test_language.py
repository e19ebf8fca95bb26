"""The fusion of evidence against plain Python, and the operator away from the source tree."""

import math
import subprocess
import sys
from pathlib import Path

import pytest

from foliosift.llm import language

EN, DE = "the house is on the hill and the road goes down to the river", "das haus steht auf dem berg und die strasse geht hinab zum fluss"
PAGES = "page_id long, url string, html string"


def fused(pages, learned, smoothing=5.0, most=60.0):
    """(page, language, probability) by the formulas, page after page."""
    langs = sorted({lang for lang, _ in learned})
    counts = {k: [0.5] * (1 << language.BITS) for k in langs}
    for lang, text in learned:
        for g in language.trigrams(text):
            counts[lang][g] += 1
    logs = {k: [math.log(x / sum(c)) for x in c] for k, c in counts.items()}
    rows = []
    for page, url, html in pages:
        grams = language.trigrams(language.HIDDEN.sub(" ", html or ""))
        ll = [sum(logs[k][g] for g in grams) * min(1.0, most / max(1, len(grams))) for k in langs]
        odds = [math.exp(x - max(ll)) for x in ll]
        host = url.split("/")[2].lower() if url else ""
        declared = html.split('lang="')[1][:2] if html and 'lang="' in html else ""
        rows.append((page, host, host.rpartition(".")[2] if "." in host else "", declared, ll, [x / sum(odds) for x in odds]))
    add = lambda own: [sum(r[5][i] for r in own) for i in range(len(langs))]
    base = [(s + 1) / (len(rows) + len(langs)) for s in add(rows)]
    told = {d: add([r for r in rows if r[3] == d]) for d in {r[3] for r in rows if r[3]}}
    spread = [sum(s[i] for s in told.values()) + 1 for i in range(len(langs))]
    out = []
    for page, host, suffix, declared, ll, p in rows:
        above = [r for r in rows if r[2] == suffix]
        of_suffix = [(s + smoothing * b) / (len(above) + smoothing) for s, b in zip(add(above), base)] if suffix else base
        near = [r for r in rows if r[1] == host]
        prior = [(max(0.0, s - x) + smoothing * b) / (len(near) - 1 + smoothing) for s, x, b in zip(add(near), p, of_suffix)] if host else base
        said = [math.log((x + 1 / (1 + len(told))) / y) for x, y in zip(told[declared], spread)] if declared else [0.0] * len(langs)
        score = [a + b + math.log(c) for a, b, c in zip(ll, said, prior)]
        out.append((page, langs[score.index(max(score))], 1 / sum(math.exp(x - max(score)) for x in score)))
    return out


@pytest.fixture(scope="module")
def cases():
    pages = [(i, f"http://h{i % 4}.com/{i}", f"<html lang=\"en\"><p>{EN[i % 9 :]}</p>") for i in range(24)]
    pages += [(100 + i, f"http://h{i % 2}.de/{i}", f"<p>{DE[i % 7 :]}</p>" if i % 3 else "<html lang=\"de\">") for i in range(12)]
    pages += [(200 + i, None, f"<p>{DE}</p>") for i in range(20)] + [(300, None, None), (301, "http://localhost/x", None), (302, "http://h0.de/y", None), (303, "http://new.com/z", "<html lang=\"fr\">"), (304, "http://localhost/w", "<p>der")]
    return pages, [("en", EN), ("de", DE)]


def test_fusion_equals_plain_python(spark, cases):
    pages, learned = cases
    got = language.identify(spark.createDataFrame(pages, PAGES), spark.createDataFrame(learned, "lang string, text string")).collect()
    want = {p: (lang, x) for p, lang, x in fused(pages, learned)}
    assert len(got) == len(pages) and all(r["lang"] == want[r["page_id"]][0] and abs(r["probability"] - want[r["page_id"]][1]) < 1e-9 for r in got)


def test_nothing_known_of_a_page_is_the_overall_prior(spark):
    pages = [(i, f"http://h{i}.com/", f"<p>{EN}") for i in range(50)] + [(100 + i, None, f"<p>{DE}") for i in range(20)] + [(200, None, "")]
    rows = {r["page_id"]: r for r in language.identify(spark.createDataFrame(pages, PAGES), spark.createDataFrame([("en", EN), ("de", DE)], "lang string, text string")).collect()}
    assert rows[200]["lang"] == "en" and abs(rows[200]["probability"] - 51.5 / 73) < 0.01


def test_without_labels_hosts_and_declarations_stay(spark, cases):
    none = spark.createDataFrame([], "lang string, text string")
    rows = {r["page_id"]: r for r in language.identify(spark.createDataFrame(cases[0], PAGES), none).collect()}
    assert len(rows) == len(cases[0]) and rows[0]["host"] == "h0.com" and rows[0]["declared"] == "en" and rows[0]["lang"] is None and rows[0]["probability"] is None


def test_workers_need_no_installed_package(tmp_path):
    """From a folder of its own, where workers can't find the package but as it is shipped."""
    root = Path(language.__file__).resolve().parents[2]
    script = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from foliosift.llm import language
pages = spark.createDataFrame([(1, "http://a.com/", "<p>{EN}")], {PAGES!r})
print("found", language.identify(pages, spark.createDataFrame([("en", {EN!r}), ("de", {DE!r})], "lang string, text string")).first()["lang"])
"""
    (tmp_path / "own.py").write_text(script)
    done = subprocess.run([sys.executable, "own.py"], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "found en" in done.stdout, done.stderr[-2000:]

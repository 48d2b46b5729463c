import re

from quirespark.llm import licenses

MIT = licenses.NOTICES[0][0]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    w = words(text)
    found = sorted((i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    return len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


TEXTS = [
    "Released under the MIT License.", "MIT  license, mit-License MIT license", "the GNU General Public License and general public\nlicense", "apache licensé", "Apache License" * 3, "APACHE LICENSE", None, "", "?!", "mit",
    "x " * 3000 + MIT + " y" * 50, MIT.replace("charge", "cost").replace("obtaining", "now obtaining") + " mit license", "general public general public license", "mıt license Kit LİCENSE", MIT + ". " + MIT, " ".join(MIT.split()[:12]),
]


def test_base_and_labels(spark):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(None, TEXTS[1], "k"), (1, TEXTS[1], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    found = licenses.digest(licenses.scan_licenses(docs)).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    for k, text, _ in rows:
        r = by[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert by[10]["labels"] == "mit" and by[10]["n_base"] == 0 and by[10]["score"] == 1
    assert by[11]["labels"] == "mit" and by[15]["labels"] == ""


def test_spans(spark):
    docs = spark.createDataFrame([(1, f"a b {MIT} c {MIT}")], "doc_id long, text string")
    spans = licenses.scan_licenses(docs).first()["spans"]
    n = len(MIT.split())
    assert [(s["start"], s["stop"], s["label"]) for s in spans] == [(2, n + 1, "mit"), (n + 3, 2 * n + 2, "mit")]


def test_empty(spark):
    assert licenses.digest(licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string"))).collect() == []

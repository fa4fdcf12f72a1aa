import random
import re

from pyspark.sql import functions as F

from tidemark.llm import license_scan as L

SCHEMA = "doc_id long, text string"


def brute(text):
    """Base places by comparing every window; method matches by counting every block of every template."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels, score = [], set(), 0.0
    for template in L.TEMPLATES:
        words = L.words(template.text)
        if template.exact:
            at = [i for i in range(len(found)) if found[i : i + len(words)] == words]
            places += [(i, template.label) for i in at]
            if at:
                labels.add(template.label)
                score = 1.0
            continue
        tokens, size = set(words), 2
        while size < 2 * len(words):
            size *= 2
        for start in range(0, len(found), size // 2):
            part = len(tokens & set(found[start : start + size])) / len(tokens)
            if part >= (template.threshold or L.THRESHOLD):
                labels.add(template.label)
                score = max(score, part)
    starts = [i for i, _ in places]
    base = ",".join(sorted({label for _, label in places}))
    return (len(found), len(starts), min(starts, default=None), max(starts, default=None), base, ",".join(sorted(labels)), score)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    common = "the of and license mit general public apache under version a to 2 0 4 cc by nc Größe".split()
    texts = [None, "", "  ", "MIT License", "mit, LICENSE mit-license", "general public\nlicense" * 3, "x" * 200000]
    for _ in range(120):
        text = [rng.choice(common) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            words = rng.choice(L.TEMPLATES).text.split()
            words = [w for w in words if rng.random() < 0.95]
            at = rng.randint(0, len(text))
            text[at:at] = words
        texts.append(rng.choice([" ", "\n", ", "]).join(text))
    rows = list(enumerate(texts)) + [(3, "MIT License"), (None, "apache license")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("matches", F.lit("clash"))
    found = sorted(map(str, (tuple(r) for r in L.report(L.scan(docs)).collect())))
    assert found == sorted(str((i, *brute(t))) for i, t in rows)


def test_spans_hold_their_phrase(spark):
    docs = spark.createDataFrame([(1, "Hello. Under the Apache License, and the MIT license too")], SCHEMA)
    (row,) = L.scan(docs).collect()
    words = L.words("Hello. Under the Apache License, and the MIT license too")
    assert {" ".join(words[m["start"] : m["end"]]) for m in row["matches"] if m["exact"]} == {"apache license", "mit license"}


def test_license_lines_get_their_own_label_only(spark):
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl", "A plain line of text.": ""}
    docs = spark.createDataFrame(list(enumerate(lines)), SCHEMA)
    found = {r["doc_id"]: r["labels"] for r in L.report(L.scan(docs)).collect()}
    assert list(found[i] for i in range(len(lines))) == list(lines.values())


def test_empty_table(spark):
    assert L.report(L.scan(spark.createDataFrame([], SCHEMA))).collect() == []


def test_positional_filter_drops_blocks():
    """Blocks that hold a prefix token and enough tokens in all, but too few behind the first common one."""
    template = L.Template("t", "t", "a b c d e f g h i j")
    other = L.Template("o", "o", "p q r s t u v w x y")
    counts = {w: n for n, w in enumerate("p q r s t u a b c d e f g h i j v w x y".split())}
    index = L.Index([template, other], counts, 0.8)
    assert index.candidates("a b c d e f g h z z".split()) == [(0, 0)]
    block = "p q r s t u a b c".split()  # nine words of the templates, three of them at or behind the first of "t"
    assert len(index.rank.keys() & set(block)) >= index.need[0] and set(block) & set(index.by_token)
    assert (0, 0) not in index.candidates(block)
    assert index.matches(block) == []


def test_filters_lose_no_match():
    rng = random.Random(6)
    vocabulary = [w for template in L.TEMPLATES for w in L.words(template.text)]
    counts = {w: rng.randint(0, 9) for w in vocabulary}
    index = L.Index(L.TEMPLATES, counts, L.THRESHOLD)
    pruned = 0
    for _ in range(300):
        found = [rng.choice(vocabulary) if rng.random() < 0.7 else "z" for _ in range(rng.randint(0, 120))]
        at = rng.randint(0, len(found))
        found[at:at] = [w for w in L.words(rng.choice(L.TEMPLATES).text) if rng.random() < 0.93]
        passed = set(index.candidates(found))
        for t, tokens in enumerate(index.tokens):
            half = index.block[t] // 2
            for block in range(len(found) // half + 1):
                if len(tokens.intersection(found[block * half : block * half + 2 * half])) >= index.need[t]:
                    assert (t, block) in passed
                else:
                    pruned += (t, block) not in passed
    assert pruned > 1000

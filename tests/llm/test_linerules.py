import glob
import random

import pytest

from slotcast.llm import linerules
from slotcast.llm.linerules import cleaned, failed_rule, in_repeated_windows, judge

FOLDER = "/root/testdata/sf0.001"


def rule(line, seen=False):
    return failed_rule(line.encode(), line.encode().split(), seen)


@pytest.mark.parametrize(("line", "want"), [
    ("A plain sentence ends here.", None), ("« Ça va ? »", None), ('He said "no."  ', None), ("Weiter geht es …", None), ("No end of a sentence", "punctuation"),
    ("BUY!! NOW!! HERE!!", "punctuation"), ("a&&& b*** c.", "punctuation"), ("Home | News | Sport | About.", "navigation"), ("Log in here", "navigation"), ("Searching for words", "punctuation"),
    ("Home is where the heart is.", None), ("All Rights Reserved.", "boilerplate"), ("This site may use cookies to work.", "boilerplate"),
])
def test_rules_of_a_line(line, want):
    assert rule(line) == want


def test_repeated_lines_are_boilerplate():
    assert rule("A plain sentence ends here.", seen=True) == "boilerplate"
    text = b"One line ends here.\n\nOne line ends here.\nno end\n"
    assert cleaned(text) == (b"One line ends here.\n\n", 1, 6, {"punctuation": 1, "navigation": 0, "boilerplate": 1})


def test_repeated_windows_equal_plain():
    rng = random.Random(1)
    for _ in range(300):
        w = [b"%d" % rng.randrange(rng.choice([2, 5, 40])) for _ in range(rng.randint(0, 60))]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        assert in_repeated_windows(w) == len(covered)
    many = [b"%d" % (i % 1_300_000) for i in range(2_600_000)]
    assert in_repeated_windows(many) == len(many)


def test_windows_beyond_packed_keys():
    many = [b"%d" % i for i in range(2_200_000)] + [b"1", b"2", b"3"]
    assert in_repeated_windows(many) == 6


def test_odd_rows_and_names(spark):
    good = "\n".join(" ".join(f"w{i}{k}" for k in range(10)) + "." for i in range(8))
    half = good + "\n" + "\n".join(" | ".join(f"m{i}{k}" for k in range(6)) for i in range(8))
    rows = [(1, None, 5), (2, "", 5), (None, good, 5), (3, good, 5), (3, good, 5), (4, half, 5), (5, good + "\nno end of a sentence here", 5), (6, "word " * 100_000, 5), (7, "short text.", 5)]
    docs = spark.createDataFrame(rows, "`my.id` long, text string, kept int")
    got = {(r.id, r.base_failed, r.kept, r.lost_words) for r in judge(docs, "my.id").collect()}
    assert got == {(1, True, False, 0), (2, True, False, 0), (None, False, True, 0), (3, False, True, 0), (4, False, False, 88), (5, False, True, 6), (6, True, False, 100_000), (7, True, False, 0)}
    texts = {r.id: r.cleaned for r in judge(docs, "my.id").collect()}
    assert texts[1] is None and texts[2] == "" and texts[4] == texts[5] == good and texts[6] == ""
    assert judge(docs.limit(0), "my.id").collect() == [] and judge(docs, "my.id").count() == len(rows)


@pytest.mark.skipif(not glob.glob(f"{FOLDER}/*.parquet"), reason="driver tables are not here")
def test_good_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    judged = {r.id: r for r in judge(docs).collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    whole = [i for i, r in judged.items() if not r.base_failed and i in quality]
    kept = {q: sum(judged[i].kept for i in whole if quality[i] == q) / sum(quality[i] == q for i in whole) for q in (0, 1)}
    assert kept[1] > 0.98 and kept[0] < 0.3
    assert linerules.MOST_LOST == 30

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelcast.llm.quality import QualityConfig, Rule, certify, keep_good, quality_verdicts, upper_bound, with_measures

from .data import documents, texts, words


def brute(text):
    t = text or ""
    w = words(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in t.split("\n") if words(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_lines": len(lines), "n_upper": len(re.findall("[A-Z]", t)), "n_letters": len(re.findall("[A-Za-z]", t)),
        "n_exclaims": len(re.findall("[!?]", t)), "n_distinct": len(set(w)),
    }


def test_measures_equal_brute_force(spark):
    rows = texts() + ["a\nb\na\n\n \na ", "| x | y |\n| x | y |", "A!! B?? #tag $5 <b>", "é " * 70]
    out = with_measures(documents(spark, rows), "m_").collect()
    for r in out:
        assert {k[2:]: r[k] for k in r.asDict() if k.startswith("m_")} == brute(r["text"]), r["text"]


def test_upper_bound_is_clopper_pearson():
    for k, n, e in ((0, 100, 0.05), (3, 200, 0.01), (10, 11, 0.1), (5, 5, 0.2)):
        u = upper_bound(k, n, e)
        if k < n:
            tail = sum(math.comb(n, i) * u**i * (1 - u) ** (n - i) for i in range(k + 1))
            assert tail == pytest.approx(e, rel=1e-6)
        else:
            assert u == 1.0
    assert upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), rel=1e-9)


RULE = Rule("symbols", "n_symbols / greatest(word_chars, 1)", (0.5, 0.3, 0.1))


def labelled(spark, good, bad):
    """Good texts with few symbols, bad ones with many; ids from 0."""
    rng = random.Random(3)
    rows = []
    for k in range(good + bad):
        w = [f"w{rng.randrange(5000)}" for _ in range(60)]
        rows.append(" ".join(x + ("##" if k >= good else "") for x in w) + " w" * 3)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < good)) for i in range(good + bad)] + [(0, 0), (None, 1), (1, None)], "doc_id long, quality int")
    return docs, labels


def test_a_cutoff_needs_enough_labels(spark):
    config = QualityConfig(risk=0.05, rules=(RULE,))
    many, few = labelled(spark, 200, 20), labelled(spark, 20, 20)
    assert certify(with_measures(many[0]), many[1], config) == {"en": {"symbols": 0.1}}
    assert certify(with_measures(few[0]), few[1], config) == {"en": {}}
    kept = {r["doc_id"]: r["kept"] for r in quality_verdicts(*many, config).collect()}
    assert all(kept[i] == (i < 200) for i in kept)
    stays = keep_good(many[0].withColumn("n_words", F.lit("clash")), many[1], config)
    assert stays.columns == ["doc_id", "text", "lang", "n_words"] and {r["doc_id"] for r in stays.collect()} == set(range(200))


def test_the_sequence_stops_where_good_documents_would_go(spark):
    docs, labels = labelled(spark, 200, 40)
    labels = labels.where("quality IS NOT NULL").unionByName(spark.createDataFrame([(i, 1) for i in range(200, 240)], "doc_id long, quality int"))
    cut = certify(with_measures(docs), labels, QualityConfig(risk=0.05, rules=(RULE,)))
    assert cut == {"en": {"symbols": 0.3}}  # a cutoff of 0.1 would take the 40 odd ones, which are good now


def test_nulls_repeats_and_empty_tables(spark):
    docs = documents(spark, [None, "", "word " * 60, " ".join(f"w{i}" for i in range(60))] * 2, [1, 2, 3, None] * 2)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_verdicts(docs, labels).collect()
    assert Counter((r["n_words"], r["base_failed"], r["kept"]) for r in out) == Counter({(0, True, False): 4, (60, True, False): 2, (60, False, True): 2})
    assert quality_verdicts(documents(spark, []), labels).count() == 0
    with pytest.raises(ValueError):
        with_measures(documents(spark, ["a"]).withColumnRenamed("key", "N_Words"))


def test_all_rules_share_one_sequence(spark):
    """300 good labels certify the whole default rule set, though no rule could have a part of the risk."""
    docs, labels = labelled(spark, 300, 20)
    kept = {r["doc_id"]: r["kept"] for r in quality_verdicts(docs, labels).collect()}
    assert all(kept[i] == (i < 300) for i in kept)

import pytest

from graphloom.llm.license_scan import RULES, SENTENCES, license_scan, oracle
from tests.llm.oracle import rows, sql_rows


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equals_sql(spark, sf):
    got = rows(license_scan(spark.read.parquet(f"{sf}/documents.parquet")))
    assert got == sql_rows(oracle(), sf) and got[1]


def test_rules_apply_to_wrapped_and_ordered_text(spark):
    mit = " ".join(SENTENCES[i] for i in (12, 13, 14, 15))
    words, lines = mit.split(), []
    while words:
        lines.append(" ".join(words[:9]))
        words = words[9:]
    texts = {
        1: "\n".join(lines), 2: mit.upper(), 3: " ".join(SENTENCES[i] for i in (12, 14, 13, 15)), 4: "Intro.\n* " + SENTENCES[10] + "\n-- " + SENTENCES[10] + " More text.",
        5: "released\nunder the mit license", 6: None, 7: "", 8: "Released under the MIT Licenses.", 9: "x. " * 50000 + SENTENCES[50], 10: " ".join(SENTENCES[i] for i in (20, 21, 22, 23)), 11: " . \n ! ",
    }
    df = spark.createDataFrame([*texts.items(), (None, SENTENCES[1]), (4, texts[4])], "doc_id long, text string").selectExpr("1 AS rule", "2 AS f", "text", "doc_id", "3 AS marks")
    got = sorted(((r.doc_id, r.rule, r.license, r.n_matches) for r in license_scan(df).collect()), key=str)
    want = [(1, "mit-text", "MIT", 1), (2, "mit-text", "MIT", 1), (4, "mit-short", "MIT", 2), (4, "mit-short", "MIT", 2), (5, "mit-short", "MIT", 1), (9, "cc-by-nc-4.0", "CC-BY-NC-4.0", 1),
            (10, "bsd-2-clause", "BSD-2-Clause", 1), (10, "bsd-3-clause", "BSD-3-Clause", 1), (None, "apache-2.0-short", "Apache-2.0", 1)]
    assert got == sorted(want, key=str)
    assert license_scan(df.limit(0)).count() == 0
    assert len({r for r, _, _ in RULES}) == len(RULES)


def test_sentences_of_one_word_a_line_are_found(spark):
    mit = "\n".join(" ".join(SENTENCES[i] for i in (12, 13, 14, 15)).split())
    df = spark.createDataFrame([(1, mit), (2, "x\n" * 300 + mit + "\nend"), (3, mit.replace("permission", "permit", 1).replace("Permission", "Permit"))], "doc_id long, text string")
    assert sorted((r.doc_id, r.rule, r.n_matches) for r in license_scan(df).collect()) == [(1, "mit-text", 1), (2, "mit-text", 1)]

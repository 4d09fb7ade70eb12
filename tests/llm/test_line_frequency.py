from sitefold.llm import line_frequency as lf
from sitefold.llm.queries import op12_line_frequency

COLS = "doc_id long, text string, source string, n_words string, line int"


def _name(i):
    """Letters for a number: digits are all alike for the rules."""
    return "".join("abcdefghij"[int(c)] for c in str(i))


def _texts(n, common="Read more at site 12"):
    return [(i, f"{common}\n" + " ".join(f"w{_name(i)}x{j}" for j in range(60)), "h", "x", 1) for i in range(n)]


def test_common_line_goes_and_documents_stay(spark):
    docs = spark.createDataFrame(_texts(30), COLS)
    got = lf.quality_verdicts(docs).collect()
    assert len(got) == 30 and all(r.kept and r.n_removed_words == 5 and len(r.removed_lines) == 1 for r in got)
    clean = {r.doc_id: r.kept_text for r in lf.cleaned_texts(docs, lf.quality_verdicts(docs)).collect()}
    assert len(clean) == 30 and all("site" not in t and t.startswith(f"w{_name(i)}x0 ") for i, t in clean.items())


def test_limits_are_per_host_and_normalised(spark):
    rows = [(i, t.replace("12", str(10 + i % 90)).replace("Read", "READ  " if i % 2 else "read"), "h" if i < 11 else "g", "x", 1) for i, t, *_ in _texts(21)]
    got = {r.doc_id: r.n_removed_words for r in lf.quality_verdicts(spark.createDataFrame(rows, COLS)).collect()}
    assert all((got[i] > 0) == (i < 11) for i in got)


def test_share_of_a_large_host(spark):
    rows = _texts(11) + [(100 + i, " ".join(f"v{_name(i)}y{j}" for j in range(50)), "h", "x", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, COLS)
    assert lf.quality_verdicts(docs).filter("n_removed_words > 0").count() == 11
    assert lf.quality_verdicts(docs, most_per_mille=50).filter("n_removed_words > 0").count() == 0


def test_depleted_documents_go_and_copies_are_one(spark):
    shell = "\n".join(f"menu {c} " + " ".join(f"{c}{j}" for j in "abcdefgh") for c in "qrstuv")
    rows = [(i, shell + f"\nown words of {'x' * i}", "h", "x", 1) for i in range(20)]
    rows += [(100 + i, " ".join(f"copy{j}" for j in range(60)), "h", "x", 1) for i in range(50)]
    got = {r.doc_id: r.kept for r in lf.quality_verdicts(spark.createDataFrame(rows, COLS)).collect()}
    assert all(got[i] == (i >= 100) for i in got)


def test_rows_of_any_kind(spark):
    rows = [(None, None, None, None, None), (1, "", "h", "x", 1), (2, "one\n\n \none\nONE", None, "x", 1), (2, "one\n\n \none\nONE", None, "x", 1), (3, "a b c " * 30, "h", None, 2)]
    got = sorted(lf.quality_verdicts(spark.createDataFrame(rows, COLS)).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got] == [
        (0, 0, 0, 0, 0, True, False), (0, 0, 0, 0, 0, True, False), (3, 9, 0, 1, 0, True, False), (3, 9, 0, 1, 0, True, False), (90, 90, 0, 0, 90, True, False),
    ]
    assert lf.quality_verdicts(spark.createDataFrame([], COLS)).count() == 0


def test_counts_of_one_text():
    assert lf.repeated_words(b"a b c d a b c".split()) == 6
    assert lf.repeated_words(b"a a a a".split()) == 4
    assert lf.repeated_words(b"a a a".split()) == 0


def test_symbols_and_characters(spark):
    docs = spark.createDataFrame([(1, "é#\t<ü>|\x0b$ %&*", "h", "x", 1)], COLS)
    r = lf.quality_verdicts(docs).first()
    assert (r.n_words, r.word_chars, r.n_symbols) == (3, 11, 8)


def test_query_columns(spark, sf):
    assert op12_line_frequency(spark, sf).columns == [
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    ]


def test_odd_rows(odd):
    got = lf.quality_verdicts(odd).collect()
    assert len(got) == odd.count()
    words = sorted(len((r.text or "").encode().split()) for r in odd.collect())
    assert sorted(r.n_words for r in got) == words
    assert lf.cleaned_texts(odd, lf.quality_verdicts(odd)).count() == sum(r.kept for r in got)

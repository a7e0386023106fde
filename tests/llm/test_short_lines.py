"""Lines of any length are units of op9 and of the pipeline's stage."""

import corpus_pipeline
from sentria.llm.queries import op9_line_dedup
from test_linededup import brute_spans

MIT, APACHE = "Released under the MIT license.", "Licensed under the Apache License, version 2.0."
ROWS = [
    (1, f"one of a kind\n{MIT}\n\n{APACHE}"),
    (2, f"{MIT}\n\nsecond of its kind\n les. \nLes."),
    (3, f"{APACHE}\n\n日本語の長い行には空白がない\nthird"),
    (4, f"日本語の長い行には空白がない\nfourth\n\n  released  under the\tMIT license."),
    (5, None),
    (6, " \n\n\t\n"),
    (None, MIT),
]


def test_short_lines_are_removed(spark, tmp_path):
    docs = spark.createDataFrame([(d, t, "en", "x", 0) for d, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: [(x.start_char, x.end_char) for x in r.spans] for r in op9_line_dedup(spark, str(tmp_path)).collect() if r.spans}
    want = {d: [x[:2] for x in spans] for (d, _), spans in brute_spans(ROWS, min_words=1).items()}
    assert got == want and set(got) == {2, 3, 4}
    texts = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert texts[1] == ROWS[0][1] and texts[None] == MIT and texts[5] is None and texts[6] == ROWS[5][1]
    assert texts[2] == "\nsecond of its kind\n les. " and texts[3].endswith("third") and APACHE not in texts[3]
    assert texts[4] == "fourth\n"

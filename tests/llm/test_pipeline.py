import corpus_pipeline
from lumiframe.llm import bpe, langid, mixing, near_dup, queries, suffix_dedup


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    dictionaries = langid.fit(docs.where(~langid.held_out()))
    one = corpus_pipeline.language_id(spark, docs, sf)
    classify = langid.Classifier(dictionaries)
    want = []
    for r in docs.collect():
        lang, score = classify((r["text"] or "").encode())
        if lang != "und" and score >= langid.MARGIN:
            want.append(r)
    assert one.columns == columns and sorted(map(tuple, one.collect())) == sorted(map(tuple, want))

    from test_near_dup import brute

    two = corpus_pipeline.near_duplicates(spark, one, sf)
    kept = {d for d, _, c in brute([(r["doc_id"], r["text"]) for r in want], 80) if d == c}
    assert two.columns == columns and sorted(r["doc_id"] for r in two.collect()) == sorted(kept)

    three = corpus_pipeline.repeated_passages(spark, two, sf)
    before = sorted(two.collect())
    from test_suffix_dedup import brute_places

    texts = [r["text"].encode() for r in before]
    after = {r["doc_id"]: r for r in three.collect()}
    assert three.columns == columns and len(after) == len(before)
    for r, b, places in zip(before, texts, brute_places(texts, suffix_dedup.LENGTH), strict=True):
        gone = {j for i in places for j in range(i, i + suffix_dedup.LENGTH)}
        text = after[r["doc_id"]]["text"]
        if not gone:
            assert text == r["text"] and after[r["doc_id"]]["n_chars"] == r["n_chars"]
        else:
            plain = bytes(x for j, x in enumerate(b) if j not in gone).decode("utf-8", "ignore")
            assert text == plain or abs(len(text) - len(plain)) <= 4
            assert after[r["doc_id"]]["n_chars"] == len(text)

    four = corpus_pipeline.mix_sources(spark, three, sf)
    copies = {r["doc_id"]: r["copies"] for r in mixing.copies(three).collect()}
    assert four.columns == columns and four.count() == sum(copies.values())

    encoder = bpe.Encoder(bpe.Vocabulary(queries.tokenizer()))
    five = corpus_pipeline.tokens(spark, four, sf)
    text = {r["doc_id"]: r["text"] for r in four.collect()}
    assert all(list(r["ids"]) == encoder([text[r["doc_id"]] or ""])[0] for r in five.collect())
    assert near_dup.PERCENT == corpus_pipeline.NEAR_PERCENT == 80 and queries.LINK_PERCENT == 85


def test_run_and_rows_without_ids(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = docs.limit(3).selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")
    blank = docs.limit(1).selectExpr("cast(-1 as bigint) as doc_id", "cast(null as string) as text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as bigint) as n_chars")
    docs.unionByName(odd).unionByName(blank).unionByName(docs.limit(2)).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.where("doc_id = -1").count() == 0
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

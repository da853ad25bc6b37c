"""Vectors of several lengths: only those of the most frequent length link."""

from leakscan.llm import embedding_dedup


def test_other_lengths_link_with_nothing(spark):
    vectors = [[1.0, 0.0, 0.0, 0.0], [1.0, 0.0], [1.0, 0.01, 0.0, 0.0], [1.0, 0.0], [0.0, 1.0, 0.0, 0.0], [1.0, 0.0, 0.0], None, [1.0, 0.0, 0.0, 0.0]]
    docs = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_duplicates(docs).collect()}
    assert got == {
        0: (2, 0, True), 1: (0, 1, True), 2: (2, 0, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), 7: (2, 0, False)
    }

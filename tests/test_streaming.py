from __future__ import annotations

from fathom.plans import index as ix
from fathom.streaming.ingest import StreamIndex, stream_lines
from tests.test_hand_corpus import DOCS, vectors


def tables(index):
    return [sorted(map(repr, t.select(sorted(t.columns)).collect())) for t in (index.postings, index.term_stats, index.doc_stats, index.stats, index.doc_vectors)]


def test_micro_batches_make_the_same_index(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    growing = StreamIndex(spark, str(tmp_path / "index"), df_cutoff=0)
    items = list(DOCS.items())
    for k in range(3):
        (source / f"{k}.txt").write_text("".join(f"{d}\t{t}\n" for d, t in items[k * 4 : k * 4 + 4]))
        query = growing.follow(stream_lines(spark, str(source)), str(tmp_path / "checkpoint"), availableNow=True)
        query.awaitTermination()
    whole = ix.build_index(vectors(spark), df_cutoff=0)
    assert tables(growing.snapshot()) == tables(whole)
    growing.add(vectors(spark, dict(items[8:])), 2)  # a batch that comes again
    growing.add(vectors(spark, {1: "other text"}), 9)  # a document that is known
    assert tables(growing.snapshot()) == tables(whole)
    growing.compact(str(tmp_path / "saved"))
    assert tables(ix.load_index(spark, str(tmp_path / "saved"))) == tables(whole)

import pyarrow as pa

from heliograde.llm import resampling


def test_block_of_a_slice_counts_its_own_words():
    texts = ["eine lange erste Zeile", "ONE two Three", "é four"]  # without nulls, so that no kernel copies the slice by the way
    part, whole = resampling.Block(pa.array(texts).slice(1)), resampling.Block(pa.array(texts[1:]))
    assert part.features().tolist() == [5, 3]
    assert (part.counts() == whole.counts()).all()
    gains = whole.counts() * 7 + 3
    assert part.weights(gains).tolist() == whole.weights(gains).tolist()

import numpy as np
import pyarrow as pa

from tessaline.llm import lm


class Asked:
    """A part of the filter that notes what it is asked for; a key's level tells it apart."""

    def __init__(self):
        self.keys = []

    def levels(self, keys):
        self.keys.append(keys)
        return (keys >> np.uint64(8)).astype(np.uint8)


def test_each_token_and_pair_is_asked_once_and_in_the_order_of_shards():
    texts = ["a b " * 500, "b a " * 500, "", "\x00 é"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.nulls(4, pa.binary()), pa.nulls(4, pa.binary())], names=["text", "own", "pair"])
    part = Asked()
    [(_, hashed, sizes, own, pair)] = lm._levels(iter([batch]), part)
    assert sizes.tolist() == [1001, 1001, 1, 3]
    assert (own == (hashed >> np.uint64(8)).astype(np.uint8)).all() and (pair == (lm.pairs(hashed) >> np.uint64(8)).astype(np.uint8)).all()
    assert all((np.diff(keys.astype(object)) > 0).all() for keys in part.keys)
    assert list(map(len, part.keys)) == [5, 10]

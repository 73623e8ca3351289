"""Python workers go on to other operators: they must not carry along what an earlier one kept or what Arrow holds unused."""

import pyarrow as pa
import public_tokenizers

from tracetally.llm import common, packing


def test_a_worker_gives_back_what_packing_kept():
    path = public_tokenizers.path("word_bpe_49k.json")
    first = packing.encoder(path)
    ids = first("some text to keep")
    assert packing.encoder(path) is first  # the next task of packing goes on with it
    common.fresh_worker()
    assert packing.encoder(path) is not first and packing.encoder(path)("some text to keep") == ids
    common.fresh_worker()
    assert not common.kept_by_worker


def test_unused_memory_of_arrow_is_given_back():
    before = pa.default_memory_pool().bytes_allocated()
    texts = pa.array(["x" * 1000] * 50_000)
    del texts
    common.fresh_worker()
    assert pa.default_memory_pool().bytes_allocated() == before

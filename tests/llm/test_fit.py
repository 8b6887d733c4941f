"""The bounds of the training sample are parameters; sentences come from the whole text."""

import inspect

import pyarrow as pa

from weftline.llm import langid


def test_bounds_are_named():
    given = {k: v.default for k, v in inspect.signature(langid.fit).parameters.items()}
    assert (given["limit"], given["sentences"]) == (langid.TRAIN_DOCUMENTS, langid.TRAIN_SENTENCES)


def test_sentences_are_drawn_from_the_whole_text():
    text = " ".join(f"The house number {chr(97 + i)}{chr(97 + i)} is on the hill." for i in range(26)) * 20
    batch = pa.record_batch([pa.array([text]), pa.array(["en"])], names=["text", "lang"])
    picked = next(langid._pick(6)([batch]))["sentence"].to_pylist()
    assert len(set(picked)) == 6 and picked == next(langid._pick(6)([batch]))["sentence"].to_pylist()
    assert max(text.lower().find(s) for s in picked) > 200

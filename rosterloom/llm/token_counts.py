"""Token counts with a whole-token shortcut.

For every string of the vocabulary that ends a word it is proved once, by asking the library,
whether the string encodes alone as that one token.  Pre-tokens among the proven strings
count one; only the rest is merged, by the library, and remembered.  Counts of pre-tokens
add up, as the pattern never joins them across a space.

Defined cases: a null text is an empty one with no tokens; texts with characters outside the range for
which the cutting is proved, or with the text of a special token, are given to the library
whole; very long texts are counted whole, a text of their own at a time; rows that repeat an id, or have none, have a
result each; an empty table gives no rows; further columns are kept out of the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.common import by_value, table, whole, worker_store
from rosterloom.llm.pretokens import PreTokens, bytes_of_signs, text_parts

by_value(__name__)

LIMIT = 2048


def proven_whole(tokenizer) -> set[str]:
    """Vocabulary strings that alone encode as their one token."""
    end, signs = tokenizer.model.end_of_word_suffix or "", bytes_of_signs()
    found = {}
    for sign, token in tokenizer.get_vocab(with_added_tokens=False).items():
        if sign.endswith(end) and all(c in signs for c in sign[: len(sign) - len(end)]):
            try:
                found[bytes(signs[c] for c in sign[: len(sign) - len(end)]).decode()] = token
            except UnicodeDecodeError:
                pass  # part of a character
    encoded = tokenizer.encode_batch_fast(list(found), add_special_tokens=False)
    return {s for (s, token), e in zip(found.items(), encoded) if e.ids == [token]}


def split_pattern(tokenizer) -> str:
    import json

    return json.loads(tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]


class Counter:
    """Counts the tokens of texts like the tokenizer does."""

    def __init__(self, tokenizer_json: str, proven: set[str]):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.proven = Tokenizer.from_str(tokenizer_json), proven
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pre_tokens = PreTokens(split_pattern(self.tokenizer), self.count_many, specials, lower=True)

    def count_many(self, pre_tokens: Iterable[str]) -> dict[str, int]:
        """One for proven pre-tokens; the rest is merged by the library."""
        rest = [p for p in pre_tokens if p not in self.proven]
        merged = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        return dict.fromkeys(pre_tokens, 1) | {p: len(e) for p, e in zip(rest, merged)}

    def count(self, texts: list[str]) -> list[int]:
        cuts = self.pre_tokens.cut(texts)
        count_of = self.pre_tokens.known.__getitem__
        return [sum(map(count_of, words)) if words is not None else len(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0]) for t, words in zip(texts, cuts)]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document: id, n_bytes, n_tokens, over_limit."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        text = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((text, proven_whole(Tokenizer.from_str(text))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("token_counts")
        if path not in store:
            store[path] = Counter(*shared.value)
        counter = store[path]
        for batch in batches:
            n = [n for _, texts in text_parts(batch["text"]) for n in counter.count(texts)]
            yield pa.record_batch([batch["id"], batch["n_bytes"], pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(whole(text_col)).cast("bigint").alias("n_bytes"), whole(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

"""Token counts by linear longest-match over a vocabulary, without building pieces.

A word is its space marker followed by its bytes, and its greedy pieces are the longest
vocabulary entries from the left.  The automaton is the trie of the vocabulary.  A node
without the next byte has a failure link to the node that holds what is left after the
pieces which are then certain, and the number of those pieces, so every byte is read once and
only numbers are added.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import as_bytes, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words remembered per task; the memory is emptied when full.
REMEMBERED = 400_000
#: Longer words are not remembered.
LONG_WORD = 64
MARK = b" "


def printable_bytes() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: visible ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The entries of a byte-level vocabulary file as bytes; a space marks the beginning of a word."""
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    table = printable_bytes()
    return [bytes(table[c] for c in e) for e in entries if all(c in table for c in e)]


@dataclass
class Automaton:
    """Per node: its children by byte, failure link (-1: none) and pieces popped when it is followed.

    Nodes are numbered breadth first; 0 is the root.  ``whole`` is the number of pieces of each
    node's own string, so a word that ends in a node needs no walk to finish.
    """

    children: list[dict[int, int]] = field(default_factory=lambda: [{}])
    fail: list[int] = field(default_factory=lambda: [-1])
    popped: list[int] = field(default_factory=lambda: [0])
    whole: list[int] = field(default_factory=lambda: [0])

    @classmethod
    def of(cls, vocabulary: list[bytes]) -> Automaton:
        """Builds the trie of all entries and single bytes, then links and counts breadth first.

        A node that is an entry pops itself and falls back to the root.  Another node extends
        its parent's string by a byte: it pops what the parent pops, and goes on by that byte
        from the parent's link, popping along further links until the byte can be read.
        """
        entries = {e for e in vocabulary if e} | {bytes([b]) for b in range(256)}
        a, last, level, is_entry = cls(), [(0, 0)], [(0, b"", sorted(entries))], [False]
        while level:
            below = []
            for node, head, words in level:
                depth = len(head)
                by_byte: dict[int, list[bytes]] = {}
                for w in words:
                    if len(w) > depth:
                        by_byte.setdefault(w[depth], []).append(w)
                for byte, some in by_byte.items():
                    child = len(a.children)
                    a.children[node][byte] = child
                    a.children.append({})
                    last.append((node, byte))
                    text = head + bytes([byte])
                    is_entry.append(text in entries)
                    below.append((child, text, some))
            level = below
        for node in range(1, len(a.children)):
            parent, byte = last[node]
            if is_entry[node]:
                a.fail.append(0)
                a.popped.append(1)
            else:
                link, pops = a.fail[parent], a.popped[parent]
                while byte not in a.children[link]:
                    pops += a.popped[link]
                    link = a.fail[link]
                a.fail.append(a.children[link][byte])
                a.popped.append(pops)
            a.whole.append(a.popped[node] + a.whole[a.fail[node]])
        return a

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of a byte string."""
        children, fail, popped, node, pieces = self.children, self.fail, self.popped, 0, 0
        for byte in word:
            while (after := children[node].get(byte)) is None:
                pieces += popped[node]
                node = fail[node]
            node = after
        return pieces + self.whole[node]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: its id, n_words, n_bytes of the text, n_tokens.

    Words are runs of ``[^\\x20\\x09-\\x0D]``.  Null and blank texts have 0 words and 0 tokens.
    A single byte is always a piece, so every text has a count.  Null ids and repeated rows are
    rows like others; other columns are not read.  The driver reads the vocabulary file and sends
    the automaton to the tasks; its size is the vocabulary's.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(Automaton.of(read_vocabulary(vocabulary)))

    def count(batches):
        automaton, known = held.value, {}
        for batch in batches:
            words, tokens, sizes = [], [], []
            for text in as_bytes(batch.column(1)):
                split = (text or b"").split()
                total = 0
                for w in split:
                    n = known.get(w)
                    if n is None:
                        n = automaton.count(MARK + w)
                        if len(w) <= LONG_WORD:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[w] = n
                    total += n
                words.append(len(split))
                tokens.append(total)
                sizes.append(len(text or b""))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, sizes, tokens))],
                names=["id", "n_words", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        count, f"id {kind}, n_words long, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)

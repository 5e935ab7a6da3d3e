"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np

from millrace.llm.common import Memo, by_stretch, kept_by_worker

#: What the pre-tokenizer of the file cuts, for lower-case ASCII and Latin-1 letters;
#: and a line end, which is put after each word.
_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+|\n")
#: Signs for which only the tokenizer knows the lower case, the classes and the normal form.
_OTHER = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]|<\|")
_WHITE = "\t\n\v\f\r "
_SPACES = np.isin(np.arange(256), [*_WHITE.encode()])


def _word_starts(data: np.ndarray) -> np.ndarray:
    """Where a word starts; the white space after it goes with it."""
    space = _SPACES[data]
    begins = ~space
    begins[1:] &= space[:-1]
    return begins


def word_encoder(path: str) -> Callable[[list[bytes | None]], list[np.ndarray]]:
    """A function from texts to their ids by the ``tokenizers`` file at ``path``.

    For files like ``word_bpe_49k.json``: white space is dropped and no token reaches over it,
    letters are lower-cased, and runs of letters, digits and other signs are apart. So the ids
    of a text are those of its runs, and a worker lets the model cut each run once; words that
    occur again among the given texts are cut into runs once. A word with a sign beyond Latin
    letters goes through the whole tokenizer. A null text has no ids.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = kept_by_worker(path, lambda: Tokenizer.from_file(path))
    to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    cut = tokenizer.model.tokenize

    signs = {code: to_bytes(chr(code))[0][0] for code in range(256)}

    def of_run(run: str) -> bytes:
        if run == "\n":
            return b""
        mapped = run if run.isascii() and run.isprintable() else run.translate(signs)
        return array("I", [token.id for token in cut(mapped)]).tobytes()

    def of_word(word: str) -> bytes:
        return array("I", tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    # Kept from task to task, as cutting runs is nearly all the work.
    runs = kept_by_worker(f"{path} runs", lambda: Memo(of_run, 48 << 20))
    words = kept_by_worker(f"{path} words", lambda: Memo(of_word))
    find, run_ids = _RUNS.findall, runs.__getitem__

    def ids_of(stretches: list[str]) -> tuple[np.ndarray, bytes]:
        plain = [stretch.strip(_WHITE) for stretch in stretches]
        other = {}
        if _OTHER.search("\n".join(plain)):
            other = {k: word for k, word in enumerate(plain) if _OTHER.search(word)}
            for k in other:
                plain[k] = ""
        cut_runs = find("\n".join([*plain, ""]).lower())
        found = list(map(run_ids, cut_runs))
        ends = np.flatnonzero(np.fromiter(map("\n".__eq__, cut_runs), bool, len(cut_runs)))
        for k, word in other.items():
            found[ends[k]] = words[word]
        sizes = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)[ends]
        return np.diff(sizes, prepend=0), b"".join(found)

    def encode(texts: list[bytes | None]) -> list[np.ndarray]:
        return by_stretch([text or b"" for text in texts], _word_starts, ids_of)

    return encode

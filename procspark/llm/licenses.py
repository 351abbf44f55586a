"""License scan: Aho-Corasick over tags and notices, shunting-yard over licence expressions."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, map_rows, texts

#: Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases in normalised words, and their labels.
NOTICES = {
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "proprietary and confidential": "proprietary",
    "gnu gpl": "gpl",
    "gplv2": "gpl-2.0",
    "gplv3": "gpl-3.0",
    "lgplv2 1": "lgpl-2.1",
    "lgplv3": "lgpl-3.0",
    "lesser general public license version 2 1": "lgpl-2.1",
    "lesser general public license version 3": "lgpl-3.0",
    "affero general public license version 3": "agpl-3.0",
    "apache software license": "apache",
    "2 clause bsd": "bsd-2-clause",
    "3 clause bsd": "bsd-3-clause",
    "mozilla public license version 2 0": "mpl-2.0",
    "eclipse public license version 2 0": "epl-2.0",
    "boost software license": "bsl-1.0",
    "zlib license": "zlib",
    "artistic license": "artistic",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "gnu free documentation license": "gfdl",
    "open database license": "odbl",
    "creative commons zero": "cc0",
    "attribution noncommercial": "cc-by-nc",
    "attribution noderivatives": "cc-by-nd",
    "attribution sharealike": "cc-by-sa",
    "no rights reserved": "public-domain",
    "do not distribute": "proprietary",
    "trade secret": "proprietary",
}
#: Licence identifiers, without a suffix for versions to come; those of Creative Commons follow a rule.
IDENTIFIERS = (
    "0bsd afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 artistic-1.0 artistic-2.0 bsd-2-clause bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 "
    "cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0 "
    "mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 postgresql psf-2.0 python-2.0 ruby sleepycat unlicense "
    "upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1"
).split()
_CREATIVE = re.compile(r"cc-by(-nc)?(-sa|-nd)?-[1-4]\.[05]")
_LATER = re.compile(r"(-only|-or-later|\+)$")
#: How far a licence family restricts use of a text, 0 to 1; the longest prefix of a label counts.
RESTRICTS = {
    "public-domain": 0.05, "unlicense": 0.05, "cc0": 0.05, "0bsd": 0.05,
    "mit": 0.1, "bsd": 0.1, "isc": 0.1, "zlib": 0.1, "apache": 0.15, "cc-by": 0.2,
    "bsl": 0.1, "artistic": 0.15, "mpl": 0.4, "epl": 0.4, "cddl": 0.4, "lgpl": 0.5, "eupl": 0.6, "gfdl": 0.6, "odbl": 0.6, "cc-by-sa": 0.6, "gpl": 0.7, "agpl": 0.8,
    "cc-by-nd": 0.8, "cc-by-nc": 0.85, "proprietary": 0.95, "reserved": 1.0,
}
UNKNOWN = 0.5
#: An exception granted by WITH takes this part of the restriction away.
EXCEPTION = 0.2
#: In normalised words, what stands before a licence expression.
TAGS = ("spdx license identifier", "license expression", "license", "licence")
_TAGGED = re.compile(rb"(?:spdx-license-identifier|^[ \t#*/-]*(?:license-expression|licen[sc]e))[ \t]*:[ \t]*([^\r\n]*)", re.I | re.M)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def restricts(label: str) -> float:
    """The restriction of the longest known prefix of a label; a middle value for unknown ones."""
    known = [k for k in RESTRICTS if label == k or label.startswith((k + "-", k + "."))]
    return RESTRICTS[max(known, key=len)] if known else UNKNOWN


def parse(expression: str) -> list[str] | None:
    """Shunting-yard: a licence expression in postfix order, or None if it isn't well formed.

    WITH binds closer than AND, AND closer than OR; operators are recognised in any case.  The first token that can't
    continue the expression at bracket level 0 ends it (the comment's end, for instance).
    """
    out, ops, operand, depth = [], [], True, 0
    for token in _TOKEN.findall(expression):
        op = token.lower()
        if token == "(":
            if not operand:
                break
            ops.append(token)
            depth += 1
        elif token == ")":
            if operand:
                return None
            if not depth:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        elif op in _BINDS:
            if operand:
                return None
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[op]:
                out.append(ops.pop())
            ops.append(op)
            operand = True
        elif operand:
            out.append(op)
            operand = False
        else:
            break
    if operand or depth:
        return None
    return out + ops[::-1]


def known(postfix: list[str]) -> bool:
    """Whether all operands are licences that exist, or a text's own references, and WITH has exceptions on its right."""
    stack: list[str] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append(token)
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with" and "exception" not in right:
            return False
        if not all(x == "" or x == right and token == "with" or _exists(x) for x in (left, right)):
            return False
        stack.append("")
    return stack == [""] or _exists(stack[0])


def _exists(name: str) -> bool:
    plain = _LATER.sub("", name)
    return plain in IDENTIFIERS or bool(_CREATIVE.fullmatch(plain)) or name.startswith("licenseref-")


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """The restriction of an expression and the licences in it: OR takes the freer side, AND the stricter one."""
    stack: list[tuple[float, set[str]]] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append((restricts(token), {token}))
            continue
        (right, names), (left, others) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left * (1 - EXCEPTION), others))
        else:
            stack.append(((min if token == "or" else max)(left, right), names | others))
    return stack[0]


_machine: ahocorasick.Automaton | None = None


def _automaton() -> ahocorasick.Automaton:
    global _machine
    if _machine is None:
        machine = ahocorasick.Automaton()
        for phrase in {*BASE, *NOTICES}:
            machine.add_word(f" {phrase} ", phrase)
        for tag in TAGS:
            machine.add_word(f" {tag} ", "")
        machine.make_automaton()
        _machine = machine
    return _machine


def _scan(batch: pa.RecordBatch) -> dict[str, object]:
    machine = _automaton()
    out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "score")}
    for text in texts(batch.column(1)):
        words = text.translate(ALNUM).split()
        line = b" " + b" ".join(words) + b" "
        places, base, labels, scores, tagged = [], set(), set(), [], False
        for end, phrase in machine.iter(line.decode("latin-1")):
            if not phrase:
                tagged = True
                continue
            if phrase in BASE:
                places.append(end - len(phrase) - 1)
                base.add(BASE[phrase])
            if phrase in NOTICES:
                labels.add(NOTICES[phrase])
        expressions = []
        if tagged:
            for m in _TAGGED.finditer(text):
                if (postfix := parse(m[1].decode("utf-8", "replace"))) and known(postfix):
                    score, names = evaluate(postfix)
                    scores.append(score)
                    labels |= names
                    expressions.append(" ".join(postfix))
        scores += [restricts(x) for x in {*base, *(labels if not expressions else ())}]
        out["n_words"].append(len(words))
        out["n_base"].append(len(places))
        out["first_word"].append(line.count(b" ", 0, min(places)) if places else None)
        out["last_word"].append(line.count(b" ", 0, max(places)) if places else None)
        out["base_labels"].append(",".join(sorted(base)))
        out["labels"].append(",".join(sorted(base | labels)))
        out["expressions"].append(expressions)
        out["score"].append(max(scores, default=0.0))
    longs, strings = pa.int64(), pa.string()
    kinds = [longs] * 4 + [strings] * 2 + [pa.list_(strings), pa.float64()]
    return {"doc_id": batch.column(0)} | {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)}


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence evidence of every whole text: one row per row of ``docs``.

    ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` for the phrases of ``BASE``;
    ``labels`` of all notices, tags and base phrases; ``expressions`` in postfix order; ``score``, the strictest
    restriction found (0: no evidence).

    Null and empty texts have no words, no labels and score 0.  Repeated rows are judged one by one, null ids are
    kept.  A tag whose expression isn't well formed, or that names a licence that doesn't exist, gives no label.  Other columns of ``docs`` aren't read.
    """
    schema = (
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string,"
        " labels string, expressions array<string>, score double"
    )
    return map_rows(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), _scan, schema)

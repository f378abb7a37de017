"""Piece segmentation, licence rules and syncmer fingerprints against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np

from flowsieve.llm import catalog, licenses, pieces, syncmers


def brute_segmentations(own, word):
    """All segmentations of a short word: (score, ids)."""
    if not word:
        return [(0, ())]
    out = []
    for end in range(1, len(word) + 1):
        found = own.scores.get(word[:end])
        if found:
            out += [(found[1] + s, (found[0], *ids)) for s, ids in brute_segmentations(own, word[end:])]
    if word[0] not in own.scores:
        raw = word[0].encode()
        out += [(own.byte_score * len(raw) + s, (*(own.byte_ids[b] for b in raw), *ids)) for s, ids in brute_segmentations(own, word[1:])]
    return out


def test_best_segmentations_are_the_best():
    own = pieces.lattice(catalog.tokenizer_file("piece_bpe_32k.model"), 6)
    for word in ("▁hello", "▁internal", "▁▁▁x", "▁naïve", "▁🙂é", "▁a", "▁aaaaaaaa"):
        every = brute_segmentations(own, word)
        found = own.n_best(word)
        assert len({ids for _, ids in found}) == len(found) == min(6, len(every))
        assert [s for s, _ in found] == sorted((s for s, _ in every), reverse=True)[:6]
        assert set(found) <= set(every)


def test_links_learnt_as_arrays_are_those_of_the_search(spark, small):
    own = pieces.Lattice(catalog.tokenizer_file("piece_bpe_32k.model"), 3)
    texts = [r.text or "" for r in catalog.documents(spark, small).collect()] + ["", " ", "🙂", "a" * 500, "\0x\0", "naïve ▁▁ 文x", "İ²."]
    chains = [own.chain(t) for t in texts]
    assert all("".join(c) == ("▁" + t.replace(" ", "▁") if t else "") for c, t in zip(chains, texts))
    list(own.encode_all(texts))
    for w in sorted(set().union(*chains))[::7] + ["🙂", "a" * 100]:
        score, gap, ids = own.links.get(w) or own.forward(w)
        found = own.n_best(w, 2)
        assert (score, tuple(np.frombuffer(ids, np.int32).tolist())) == found[0], w
        assert gap == (found[0][0] - found[1][0] if len(found) > 1 else None), w
        assert own.forward(w) == (score, gap, ids)


def test_best_texts_from_best_words():
    own = pieces.Lattice(catalog.tokenizer_file("piece_bpe_32k.model"), 5)
    text = "the cat in it"
    every = [(0, ())]
    for word in ("▁the", "▁cat", "▁in", "▁it"):
        every = [(s + t, (*a, *b)) for s, a in every for t, b in brute_segmentations(own, word)]
    found = own.encode(text)
    assert [s for s, _ in found] == sorted((s for s, _ in every), reverse=True)[:5]
    assert all(own.decode(ids.tolist()) == text for _, ids in found)


def test_pieces_round_trip_of_whole_table(spark, small):
    docs = catalog.documents(spark, small)
    rows = catalog.QUERIES["op3_pieces"](spark, small).where("rank = 1").collect()
    assert len(rows) == docs.count() and all(r.round_trip for r in rows)
    path = catalog.tokenizer_file("piece_bpe_32k.model")
    again = {r.doc_id: r.text for r in pieces.decode_ids(pieces.encode_ids(docs, path), path).collect()}
    assert again == {r.doc_id: (r.text or "").replace("▁", " ") for r in docs.collect()}


def test_pieces_of_odd_rows(odd):
    path = catalog.tokenizer_file("piece_bpe_32k.model")
    rows = pieces.segment(odd, path, 3).collect()
    assert sum(r["rank"] == 1 for r in rows) == odd.count() and all(r.round_trip for r in rows)
    assert {(r["rank"], r.n_pieces, r.score) for r in rows if r.doc_id in (2, 3)} == {(1, 0, 0.0)}
    assert pieces.segment(odd.where("false"), path).count() == 0


def test_every_known_sentence_has_a_mark():
    for forms in licenses.SENTENCES.values():
        assert all(any(m in s.lower() for m in licenses.MARKS) for s in forms)
    assert {n for _, names in licenses.RULES for n in names} <= set(licenses.SENTENCES)


def test_licences(make):
    s = {name: forms[0] for name, forms in licenses.SENTENCES.items()}
    mit = " ".join([s["mit-grant"], s["mit-notice"], s["mit-as-is"]])
    wrapped = mit.replace(", ", ",\n").replace("copies of", "copies\n  of")
    bsd3 = "\n".join(s[n] for n in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names"))
    docs = make([
        (1, f"Some code. {mit} The end."), (2, wrapped), (3, bsd3), (4, bsd3.rsplit("\n", 1)[0]), (5, "A tale of licences and copyright. Nothing here."),
        (6, "x " * 50_000 + ". " + s["gpl3-line"].upper()), (7, f"{s['apache-line']} text between. {s['cc-by-line']}"), (8, None), (9, ""),
        (10, f"{s['bsd-names']} {s['bsd-binary']} {s['bsd-source']} {s['bsd-redistribution']}"),  # not in order
    ])
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    want = {1: ["MIT"], 2: ["MIT"], 3: ["BSD-3-Clause"], 4: ["BSD-2-Clause"], 5: [], 6: ["GPL-3.0"], 7: ["Apache-2.0", "CC-BY-4.0"], 8: [], 9: [], 10: []}
    assert {i: list(r.licenses) for i, r in got.items()} == want
    m = got[1].matches[0]
    assert m.sentences == 3 and f"Some code. {mit} The end."[m.begin : m.end] + "." == mit


HEADER = """{mark} Copyright (C) 2020 Somebody
{mark}
{mark} This {what} is free software{sep} you can redistribute it and/or modify
{mark} it under the terms of the GNU {name} as published by
{mark} the Free Software Foundation{mid} either version {version} of the License, or
{mark} (at your option) any later version.
{mark}
{mark} This {what} is distributed in the hope that it will be useful,
{mark} but WITHOUT ANY WARRANTY; without even the implied warranty of
{mark} MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


def test_published_headers_name_their_own_version(make):
    general, lesser, affero = ("General Public License", "Lesser General Public License", "Affero General Public License")
    cases = [("GPL-3.0", "program", ":", general, ",", "3"), ("GPL-2.0", "program", ";", general, ";", "2"), ("AGPL-3.0", "program", ":", affero, ",", "3"),
             ("LGPL-2.1", "library", ";", lesser, ";", "2.1"), ("LGPL-3.0", "library", ":", lesser, ",", "3")]
    docs, want = [], {}
    for licence, what, sep, name, mid, version in cases:
        for mark in ("", "#", " *", "//", "--"):
            want[len(docs)] = [licence]
            docs.append((len(docs), HEADER.format(mark=mark, what=what, sep=sep, name=name, mid=mid, version=version)))
    others = [("This program is free software: you may read it.", []), ("This program is free software", []), ("// SPDX-License-Identifier: GPL-2.0-only\nint x;", ["GPL-2.0"]),
              ("# SPDX-License-Identifier: MIT\n", ["MIT"]), ("SPDX-License-Identifier: MITRE", []),
              ("This Source Code Form is subject to the terms of the Mozilla Public\n License, v. 2.0. If a copy of the MPL was not distributed", ["MPL-2.0"]),
              ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n", ["ISC"]),
              ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", ["0BSD"])]
    for text, licences in others:
        want[len(docs)] = licences
        docs.append((len(docs), text))
    assert {r.doc_id: list(r.licenses) for r in licenses.scan(make(docs)).collect()} == want


def plain_licences(text):
    """Licences of single-sentence rules, looked up with the bare words of the whole text; and all names that a longer rule could give."""
    words = f" {licenses.normalise(text)} "
    held = {n for n, forms in licenses.SENTENCES.items() if any(f" {licenses.normalise(f)} " in words for f in forms)}
    return {lic for lic, names in licenses.RULES if set(names) <= held}


def test_licences_of_whole_table_and_odd_rows(spark, small, odd):
    docs = {r.doc_id: r.text for r in catalog.documents(spark, small).collect()}
    got = {r.doc_id: set(r.licenses) for r in catalog.QUERIES["op4_licenses"](spark, small).collect()}
    want = {i: plain_licences(t or "") for i, t in docs.items()}
    assert got == want
    assert any(want.values()) and licenses.scan(odd).count() == odd.count() and licenses.scan(odd.where("false")).count() == 0


def plain_anchors(text, k, s):
    """Starts of the k-mers whose least inner hash is at an edge, one by one."""
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inner = syncmers._hashes(chars, k, s)[s]
    out = []
    for i in range(len(text) - k + 1):
        own = inner[i : i + k - s + 1].tolist()
        if min(own) in (own[0], own[-1]):
            out.append(i)
    return out


def test_anchors_are_closed_syncmers(monkeypatch):
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdefgh é文"), 3000))
    for k, s in ((32, 8), (8, 4)):
        assert syncmers._anchors(np.frombuffer(text.encode("utf-32-le"), np.uint32), k, s)[1].tolist() == plain_anchors(text, k, s)
    whole = syncmers.Fingerprint(text)
    again = syncmers.Fingerprint.decode(whole.encode())
    assert (again.at == whole.at).all() and (again.hashes == whole.hashes).all()
    monkeypatch.setattr(syncmers, "CHARS_AT_ONCE", 100)
    cut = syncmers.Fingerprint(text)
    assert (cut.at == whole.at).all() and (cut.hashes == whole.hashes).all()
    moved = syncmers.Fingerprint("A prefix of some length. " + text)  # the same anchors wherever the passage stands
    assert set(zip(whole.hashes.tolist(), (whole.at + 25).tolist())) <= set(zip(moved.hashes.tolist(), moved.at.tolist()))


def test_likeness_has_no_step_in_length():
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("abcdefgh "), 400))
    for n in (60, 120, 127, 128, 129, 150, 300):
        a, b = syncmers.Fingerprint(text[:n]), syncmers.Fingerprint(text[: n - n // 5])
        assert syncmers.likeness(a, b) > 0.6, n
    assert syncmers.likeness(syncmers.Fingerprint(text[:127]), syncmers.Fingerprint(text[:128])) > 0.9


def check_fingerprints(rows, docs):
    """``docs`` in the order in which each is followed by its next."""
    want = Counter()
    for (doc_id, text), (_, after) in zip(docs, [*docs[1:], *docs[:1]]):
        cut = len(text) // 3
        changed = text[: len(text) - cut] + after[:cut]
        own, new, other = (syncmers.Fingerprint(t) for t in (text, changed, after))
        want[doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.encode(), new.encode(), syncmers.likeness(own, new), syncmers.likeness(own, other)] += 1
    assert Counter(map(tuple, rows)) == want


def test_fingerprints_of_whole_table(spark, small):
    docs = [(r.doc_id, r.text or "") for r in catalog.documents(spark, small).orderBy("doc_id", ascending=False).collect()]
    rows = catalog.QUERIES["op8_syncmers"](spark, small).collect()
    check_fingerprints(rows, docs)
    long = [r for r in rows if r.n_chars > 200]
    assert np.mean([r.near_edited for r in long]) > 0.5 and np.mean([r.near_next for r in long]) < 0.1


def test_fingerprints_of_odd_rows(odd, make):
    docs = sorted([(r.doc_id, r.text or "") for r in odd.collect()], key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    check_fingerprints(syncmers.fingerprint_documents(odd).collect(), docs)
    alone = syncmers.fingerprint_documents(make([(5, "alone in its table")])).collect()
    assert [r.near_next for r in alone] == [1.0]
    assert syncmers.fingerprint_documents(odd.where("false")).count() == 0
    assert zlib.crc32(b"") == 0

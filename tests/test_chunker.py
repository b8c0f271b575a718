from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators.chunker import chunk_markdown

README = "# Sistema de Turnos\n\nintro\n\n## Autenticacion\nlogin con token\n\n## Notificaciones\navisos"


def test_headings_and_numbers():
    found = chunk_markdown(README)
    assert [h for _, h, _ in found] == ["Sistema de Turnos", "Autenticacion", "Notificaciones"]
    assert [i for i, _, _ in found] == [0, 1, 2]
    assert found[1][2].startswith("## Autenticacion")


def test_fences_hide_headings():
    assert len(chunk_markdown("# a\n```\n# not one\n```\nend")) == 1
    assert len(chunk_markdown("# a\n~~~\n# not one\n```\n# b")) == 2  # any marker closes


def test_blank_and_null():
    assert chunk_markdown("  \n ") == chunk_markdown(None) == chunk_markdown("") == []


def test_long_section_overlaps():
    body = "\n\n".join(" ".join(["word"] * 60) for _ in range(4))
    found = chunk_markdown(f"# t\n\n{body}", 400, 50)
    assert len(found) > 1 and all(len(t) <= 400 + 50 + 2 for _, _, t in found)


def test_raw_slices():
    text = "".join(chr(97 + i % 26) for i in range(3000))
    assert [t for _, _, t in chunk_markdown(text)] == [text[i : i + 1200] for i in range(0, 3000, 1050)]


def test_normalizing():
    assert chunk_markdown("﻿# a\r\nb c") == [(0, "a", "# a\nb c")]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab# \n`~x", max_size=400), st.integers(5, 60), st.integers(0, 80))
def test_properties(text, most, overlap):
    found = chunk_markdown(text, most, overlap)
    assert [i for i, _, _ in found] == list(range(len(found)))
    assert all(t.strip() and len(t) <= 2 * most + 2 for _, _, t in found)
    seen = "".join(t for _, _, t in found)
    assert all(seen.count(c) >= (text.count(c) > 0) for c in "abx")


def test_the_table_function_takes_documents_one_by_one(spark, monkeypatch):
    """Not ten thousand of them as one Arrow batch."""
    from pyspark.util import PythonEvalType

    from quillspark.operators import chunker

    kept = []
    monkeypatch.setattr(type(spark.udtf), "register", lambda self, name, f: kept.append(f))
    chunker.register_udtf(spark)
    assert [f.evalType for f in kept] == [PythonEvalType.SQL_TABLE_UDF]

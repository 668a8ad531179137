"""Licence notices wrapped over lines, with and without comment marks."""

from __future__ import annotations

from gridlark.llm import queries

GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
MIT = "Permission is hereby granted, free of charge, to any\nperson obtaining a copy\nof this software and associated files"


def test_wrapped_notices(spark, tmp_path):
    marked = "/*\n" + "\n".join(f" * {x}" for x in GPL.splitlines()) + "\n */\n\nint main() {}"
    hashed = "\n".join(f"# {x}" for x in MIT.splitlines())
    texts = [GPL, marked, hashed, "Released under the MIT License.\nand more", "a public library\nopen in general\n\nversion 3 of it", "GNU General\n\nPublic License, version\n\n3", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(queries.op3_licenses(spark, str(tmp_path)).collect())
    assert [r.families for r in rows] == ["gpl-3.0", "gpl-3.0", "mit", "mit", "", "", ""]
    assert [r.n_confirmed for r in rows] == [1, 1, 1, 1, 0, 0, 0]

from pathlib import Path

from matchloom.plans import storage
from matchloom.sources import shared

SF = "/root/testdata/sf0.001"


def test_feeds_are_compressed_and_their_rows_not_evened_out(spark, tmp_path, monkeypatch):
    evened = []
    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path / "feeds"))
    monkeypatch.setattr(storage, "written", lambda df, even=True: evened.append(even) or shared.written(df, even))
    storage._conformed(spark, SF)
    parts = [p for p in Path(tmp_path / "feeds").rglob("part-*")]
    assert parts and all(p.name.endswith(".csv.gz") for p in parts)
    assert evened == [False, False]

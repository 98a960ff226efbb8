from tarn.sources.tables import drop_scratch, read_table, scratch, scratch_dir

__all__ = ["drop_scratch", "read_table", "scratch", "scratch_dir"]

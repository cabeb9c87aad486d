"""Tables written to the folder that the driver and all executors share."""
from ..shared import bucket_path, bucketed, clear, dropped, materialise, result, scratch, shared_dir

__all__ = ["bucket_path", "bucketed", "clear", "dropped", "materialise", "result", "scratch", "shared_dir"]

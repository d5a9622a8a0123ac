"""fleetframe: fleet-management table operators on Spark DataFrames.

Every operator is a plain function ``DataFrame -> DataFrame`` built from
the DataFrame API, so Catalyst plans it and pushes filters and column
pruning into the scans.
"""

from fleetframe.session import checkpoint_dir, get_session

__all__ = ["checkpoint_dir", "get_session"]

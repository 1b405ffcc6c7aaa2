"""Writers: partitioned tables and views, snapshots, run summaries, retention."""

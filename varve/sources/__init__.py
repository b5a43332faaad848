"""The store on disk: sorted Parquet runs, the manifest and the framed log."""

"""Reading folders, headers and digests, and keeping catalogue tables as snapshots."""

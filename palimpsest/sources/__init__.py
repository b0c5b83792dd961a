"""Raw layouts: write-ahead logs, table files, manifests, wire requests."""

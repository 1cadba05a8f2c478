"""Sources: files, manifests, commit history, state tables and derived corpora."""

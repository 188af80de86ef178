"""An extension: the same column functions over streams, committed batch by batch. The batch engine does not need it."""

"""Relational and array operators; every public function takes and returns DataFrames."""

"""Tables, dimensions and file listings."""

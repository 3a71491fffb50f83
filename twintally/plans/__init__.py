"""Reports and runs over many pairs."""

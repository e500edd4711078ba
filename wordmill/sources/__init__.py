"""Tables, files and the store."""

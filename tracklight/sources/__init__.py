"""Tables, imports and sinks."""

"""Tables, panels, connectors and sinks."""

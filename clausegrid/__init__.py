"""Rule evaluation over large document collections, expressed as Spark plans."""

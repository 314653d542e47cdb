"""Analytics over versioned technical documents, as Spark DataFrame operators."""

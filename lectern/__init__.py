"""Analytics over large structured text libraries, as Spark plans."""

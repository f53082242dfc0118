"""Graph, transit and table analytics as Spark plans."""

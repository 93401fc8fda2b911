"""muralis: facade-inspection analytics and large-scale table operators on PySpark."""

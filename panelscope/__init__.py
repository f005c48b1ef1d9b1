"""panelscope: display-panel inspection analytics as Spark DataFrame jobs."""

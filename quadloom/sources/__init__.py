"""Where documents and quads come from, and how quads are written."""

"""Views: immutable descriptions of what a user looks at, which become one lazy DataFrame."""

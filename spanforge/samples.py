"""Synthetic shell calls with what a reader of them must find, for queries and tests.

A command's data is between ⟦ and ⟧, and {n} stands for a number that differs from row to row, so that a table of any
size has as many distinct commands. Expected: kinds of data, hiding forms, and labels of what the command does.
"""

from __future__ import annotations

# (command, kinds, hiding forms, labels); each list is joined by blanks
SAMPLES: list[tuple[str, str, str, str]] = [
    # data, and what is no data
    ("echo ⟦'rm -rf /srv/{n}'⟧ && ls", "doc", "", ""),
    ("printf ⟦'%s'⟧ ⟦'git push -f {n}'⟧ | head -3", "doc", "", ""),
    ("echo 'rm -rf /srv/{n}' > ls; ./ls", "", "", ""),
    ("echo ⟦'rm -rf /srv/{n}'⟧ > notes.txt; cat notes.txt", "doc", "", ""),
    ("echo 'rm -rf build{n}' > a.sh; bash a.sh", "", "", ""),
    ("echo 'rm -rf build{n}' | sh", "", "piped-script", ""),
    ("echo ⟦'a{n}'⟧ | grep ⟦a⟧ | wc -l", "doc search", "", ""),
    ("echo 'a{n}' | grep a | tee x.sh | wc -l; make", "", "", ""),
    ("grep -rn ⟦'DROP TABLE t{n}'⟧ src", "search", "", ""),
    ("rg -A 3 -e ⟦'rm -rf {n}'⟧ --glob '*.py'", "search", "", ""),
    ("rg --pre ./x 'rm -rf {n}' .", "", "", ""),
    ("sort --compress-program=./x.sh big{n}.txt", "", "", ""),
    ("echo 'rm -rf {n}' | sort --compress-program=./x.sh", "", "", ""),
    ("which ⟦rm{n}⟧; man ⟦git-push⟧", "search", "", ""),
    ("git log --grep ⟦'rm -rf {n}'⟧ | less", "search", "", ""),
    ("git grep -n ⟦'push --force {n}'⟧ src", "search", "", ""),
    ("git commit -m ⟦'drop the rm -rf {n}'⟧", "doc", "", ""),
    ("git -C /srv/app tag -m ⟦'v{n} rm -rf'⟧ v{n}", "doc", "", ""),
    ("gh pr create --title ⟦'rm -rf {n}'⟧ --body ⟦'git push -f'⟧", "doc", "", ""),
    ("npx vitest run -t ⟦'rm -rf {n}'⟧", "test-string", "", ""),
    ("cat <<'EOF' > plan{n}.md\n⟦rm -rf /srv\ngit push -f⟧\nEOF\n", "heredoc", "", ""),
    ("cat <<'EOF' > run{n}.sh\nrm -rf build\nEOF\nsh run{n}.sh", "", "", ""),
    ("ls -la ⟦# rm -rf {n}⟧", "doc", "", ""),
    ("echo $(date +{n})", "", "command-substitution", ""),
    ("(echo ⟦'x{n}'⟧; echo ⟦b⟧) | head", "doc", "", ""),
    ("echo x{n} > .git/hooks/pre-commit; git commit -m ⟦y⟧", "doc", "git-hook", ""),
    # forms that hide
    ("bash -c 'rm -rf dist{n}'", "", "shell-string", "rm:path"),
    ("python3 -c 'print({n})'", "", "inline-code", ""),
    ("node -e 'console.log({n})'", "", "inline-code", ""),
    ("find . -name '*.{n}' -exec rm {} +", "", "find-exec", ""),
    ("ls | xargs -n {n} rm", "", "xargs", ""),
    ("diff <(ls a{n}) b", "", "process-substitution", ""),
    ("eval \"ls {n}\"", "", "eval", ""),
    ("git -c alias.x=y{n} log", "", "git-config", ""),
    ("git rebase -x make HEAD~{n}", "", "git-exec", ""),
    ("echo 'open {n}", "", "unterminated-quote", ""),
    ("curl -s https://get.example.com/{n} | bash", "", "piped-script", ""),
    # installs
    ("npm install left-pad@{n}", "", "", "install:npm"),
    ("npm ci --prefix p{n}", "", "", "restore:npm"),
    ("cd web{n} && npm i && pnpm add x && yarn", "", "", "restore:npm install:pnpm restore:yarn"),
    ("pip install -r requirements{n}.txt", "", "", "restore:pip"),
    ("python3 -m pip install pkg=={n}", "", "", "install:pip"),
    ("pip install -e .", "", "", "restore:pip"),
    ("uv sync; uv add x{n}; uv pip install y", "", "", "restore:uv install:uv install:uv"),
    ("poetry install; poetry add p{n}; pipenv install; pipenv install q", "", "", "restore:poetry install:poetry restore:pipenv install:pipenv"),
    ("cargo add c{n}; go get g@v{n}; go mod download; gem install r", "", "", "install:cargo install:go restore:go install:gem"),
    ("bundle install; bundle add b{n}; composer require v/p; composer install", "", "", "restore:bundler install:bundler install:composer restore:composer"),
    ("sudo env A={n} npm install", "", "", "restore:npm"),
    # what leaves the machine
    ("curl -T report{n}.txt https://example.com/in", "", "", "upload:http-upload:leaving"),
    ("curl -F file=@a{n} http://localhost:80/x", "", "", "upload:http-upload:local"),
    ("curl -d @b{n}.json -H 'A: b' https://h.example.com", "", "", "upload:http-upload:leaving"),
    ("curl -d x={n} https://h.example.com", "", "", ""),
    ("curl -x http://p:1 -T f{n} http://localhost/x", "", "", "upload:http-upload:leaving"),
    ("wget --post-file=a{n} https://h.example.com", "", "", "upload:http-upload:leaving"),
    ("scp -P 22 a{n} me@h.example.com:/in", "", "", "upload:file-copy:leaving"),
    ("scp me@h.example.com:/out/{n} .", "", "", ""),
    ("rsync -a d{n}/ localhost:/in", "", "", "upload:file-copy:local"),
    ("aws s3 cp f{n} s3://bucket/k", "", "", "upload:cloud-storage:leaving s3"),
    ("aws --endpoint-url http://localhost:4566 s3 cp f{n} s3://b/k", "", "", "upload:cloud-storage:local local-stack"),
    ("aws s3 cp s3://b/{n} .", "", "", ""),
    ("gsutil cp f{n} gs://b; rclone copy d remote:x", "", "", "upload:cloud-storage:leaving upload:cloud-storage:leaving"),
    ("gh gist create notes{n}.md", "", "", "upload:paste:leaving"),
    ("nc -w 3 h.example.com 9{n} < dump", "", "", "upload:raw-socket:leaving"),
    ("ngrok http 8{n}; cloudflared tunnel run; cloudflared version", "", "", "tunnel:leaving tunnel:leaving"),
    ("ssh -R 80:localhost:{n} me@h.example.com", "", "", "tunnel:leaving"),
    # checks that are skipped
    ("git commit --no-verify -m ⟦x{n}⟧", "doc", "", "no-verify"),
    ("git commit -nm x{n}", "", "", "no-verify"),
    ("git commit -am ⟦'no -n {n}'⟧", "doc", "", ""),
    ("HUSKY=0 git push origin feature{n}", "", "", "husky push:other"),
    ("git push --no-verify origin HEAD:main", "", "", "other-no-verify push:main"),
    ("SKIP=lint git commit -m ⟦x{n}⟧", "doc", "", "one-command"),
    ("git config core.hooksPath /dev/null{n}; git config --get core.hooksPath", "", "", "hooks-path"),
    ("export HUSKY=0; ls {n}", "", "", "husky"),
    # work that is lost, pushes
    ("git branch -D topic{n}", "", "", "branch-delete"),
    ("git branch -d topic{n}; git branch -rD origin/x", "", "", ""),
    ("git stash drop; git stash clear; git stash pop {n}", "", "", "stash-drop stash-clear"),
    ("git reset --hard HEAD~{n}; git checkout -- a b; git clean -fdn; git clean -fd", "", "", "discard-all discard-paths discard-all"),
    ("git restore --staged a{n}; git restore a{n}; git restore .", "", "", "discard-paths discard-all"),
    ("git worktree add ../w{n}; cp -r a b; cp a b", "", "", "copy copy"),
    ("git push -f origin master; git push; git push --dry-run origin main {n}", "", "", "push:main push:current push:dry-run"),
    ("git push origin +feature{n}:refs/heads/main other", "", "", "push:main push:other"),
    # cloud
    ("aws iam create-access-key --user-name u{n}; aws iam list-users", "", "", "iam:access-keys"),
    ("aws --profile p iam attach-role-policy --role-name r{n}; aws iam delete-user --user-name x", "", "", "iam:policies iam:users"),
    ("aws autoscaling set-desired-capacity --x {n}; aws s3 rb s3://b{n}; aws s3api put-object --bucket b", "", "", "auto-scaling s3 s3"),
    ("awslocal s3 mb s3://b{n}", "", "", "local-stack"),
    ("terraform plan; terraform -chdir=x{n} apply -auto-approve; terragrunt run-all destroy; tofu state rm a", "", "", "terraform:unasked terraform terraform"),
    # what is destroyed
    ("rm -rf \"$DIR{n}\" \"${X:?}/a\" '/srv/$a'", "", "", "rm:unguarded-variable rm:guarded-variable rm:path"),
    ("rm -rf ~ / /home /tmp/x{n} node_modules ../dist/a src/lib", "", "", "rm:home-or-above rm:home-or-above rm:home-or-above rm:scratch-name rm:scratch-name rm:path rm:path"),
    ("rm -r a{n}*/../b x*/y; rm a; rm -f b", "", "", "rm:could-not-check rm:path"),
    ("psql -h localhost -d app_test -c 'DROP TABLE t{n}'; psql -c 'drop table t'", "", "", "db:scratch db:unresolved"),
    ("psql postgres://u@db.example.com/app{n} -c 'truncate t'; dropdb -h localhost app", "", "", "db:other db:local"),
    ("mysql -h 127.0.0.1 -e 'drop database app{n}'; redis-cli flushall; redis-cli -h r.example.com flushdb", "", "", "db:local db:local db:other"),
    ("mongosh mongodb://localhost/ci_{n} --eval 'db.dropDatabase()'; npx prisma migrate reset", "", "", "db:scratch db:unresolved"),
    ("rails db:drop; sqlite3 /tmp/x{n}.db 'drop table t'; sqlite3 app.db 'select 1'", "", "", "db:unresolved db:scratch"),
    ("ls {n} && pwd", "", "", ""),
]

FOLDER, HOME = "/home/u/app", "/home/u"
COLUMNS = "k long, template string, kinds string, forms string, labels string"


def rows() -> list[tuple]:
    """(k, template, kinds, forms, labels)."""
    return [(k, *s) for k, s in enumerate(SAMPLES)]


def values_sql() -> str:
    """The same rows as SQL."""
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows()) + ") AS samples(k, template, kinds, forms, labels)"
